import re

from budgetlens.llm.registry import LLM_ORACLES, LLM_QUERIES


def test_one_query_per_operator_and_sql_strings():
    numbers = [int(m[1]) for k in LLM_QUERIES if (m := re.match(r"op(\d+)_", k))]
    assert sorted(numbers) == list(range(1, 14))
    assert set(LLM_ORACLES) <= set(LLM_QUERIES) and all(isinstance(x, str) for x in LLM_ORACLES.values())


def test_entry_has_operators_and_pipeline():
    import __spark_entry__ as E
    assert set(LLM_QUERIES) | {"pipeline"} <= set(E.queries()) and set(LLM_ORACLES) <= set(E.oracle_sql())
