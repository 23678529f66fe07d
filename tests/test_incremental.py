"""Report states per delivery: equal to a full recompute after every change."""

from __future__ import annotations

import random

import pytest

from budgetlens.operators import aggregates as A
from budgetlens.operators import incremental as IN
from budgetlens.plans.inspect import count_nodes, plan_text
from budgetlens.session import scratch_path
from tests.conftest import make_facts

PAIRS = [(IN.summary, A.summary), (IN.department_summary, A.department_summary), (IN.state_summary, A.state_summary),
         (IN.context_stats, A.context_stats)]


def rows(seed, n, hot=False):
    rng = random.Random(seed)
    return [{"Project_ID": f"{seed}-{i}", "State": "Hot" if hot and i % 3 else rng.choice(["A", "B", None]), "District": rng.choice(["d1", "d2"]),
             "Ministry": rng.choice(["m1", "m2", "m3"]), "Department": rng.choice(["Health", "Roads", None]),
             "Allocated_Budget_Cr": rng.choice([None, 10, 33.33, 99999.99]), "Actual_Spending_Cr": rng.choice([None, 1.2345, 50]),
             "Utilization_Percentage": rng.choice([None, 5, 49.99, 50, 151]), "Delay_Days": rng.choice([None, 0, 91]),
             "Anomaly_Tag": rng.choice([None, "Normal", "NORMAL", "Delayed Release"])} for i in range(n)]


def same(spark, path, deliveries):
    full = make_facts(spark, [r for d in deliveries.values() for r in d])
    state = IN.read_state(spark, path)
    for mine, theirs in PAIRS:
        got, want = mine(state), theirs(full)
        assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
        assert got.collect() == want.collect(), mine.__name__


def test_deliveries_replacements_and_removals(spark):
    path = scratch_path(spark, "states")
    same(spark, path, {})  # nothing yet
    deliveries = {}

    def put(name, data):
        deliveries[name] = data
        IN.apply_delivery(make_facts(spark, data), path, name)

    put("2024-01", rows(1, 40))
    put("2024-02", rows(2, 60, hot=True))
    put("odd/name = 3", rows(3, 5))
    same(spark, path, deliveries)
    put("2024-02", rows(4, 20))  # the hot State is gone with the replacement
    same(spark, path, deliveries)
    assert "Hot" not in [r.State for r in IN.read_state(spark, path).select("State").distinct().collect()]
    put("2024-02", rows(4, 20))  # the same once more changes nothing
    same(spark, path, deliveries)
    put("odd/name = 3", [])
    same(spark, path, deliveries)
    IN.remove_delivery(spark, path, "2024-01")
    del deliveries["2024-01"]
    same(spark, path, deliveries)
    IN.remove_delivery(spark, path, "never came")
    same(spark, path, deliveries)


@pytest.mark.parametrize("department", ["Health", "none such"])
def test_one_department(spark, department):
    path = scratch_path(spark, "states")
    data = rows(9, 50)
    IN.apply_delivery(make_facts(spark, data), path, "x")
    assert IN.department_summary(IN.read_state(spark, path), department).collect() == A.department_summary(make_facts(spark, data), department).collect()


def test_a_delivery_is_one_pass_and_reports_read_states_only(spark, small_facts):
    assert count_nodes(IN.partial_state(small_facts), "Exchange") == 1 and "partial_sum" in plan_text(IN.partial_state(small_facts))
    path = scratch_path(spark, "states")
    IN.apply_delivery(small_facts, path, "all")
    assert "Project_ID" not in plan_text(IN.summary(IN.read_state(spark, path)))
