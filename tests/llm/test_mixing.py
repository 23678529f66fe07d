import duckdb

from budgetlens.llm import mixing as M
from tests.conftest import SF_SMALL


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    rel = con.sql(M.ORACLE)
    got = M.op4_mixing(spark, SF_SMALL).select(*rel.columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(rel.fetchall())


def test_targets_stop_and_reshare(spark):
    src = spark.createDataFrame([("a", 100, 3.0), ("b", 100, 1.0), (None, 400, 2.0)], "source string, source_size long, weight double")
    t = {r.source: r.target for r in M.targets(src).collect()}
    assert t["a"] == 200.0 and abs(sum(t.values()) - 900) < 1e-9 and abs(t[None] / t["b"] - 2) < 1e-9 or t["b"] == 200.0
    assert all(v <= 2 * s + 1e-9 for v, s in ((t["a"], 100), (t["b"], 100), (t[None], 400)))


def test_weights_follow_code_points_null_last(spark, make_docs):
    docs = make_docs([(i, "w " * 5, "en", s) for i, s in enumerate(["b", "a", None, "B", "é"])])
    rows = M.ranked_sources(M._keyed(docs), 3).collect()
    assert {r.source: r.weight for r in rows} == {"B": 3.0, "a": 1.0, "b": 2.0, "é": 3.0, None: 1.0}


def test_nested_thresholds_and_edge_rows(make_docs):
    rows = [(i, "w " * (i % 7), "en", "hot" if i % 3 else None) for i in range(300)] + [(5, None, "en", "x"), (None, "a b", "en", "x"), (7, "a b", "en", "x"), (7, "a b", "en", "x")]
    docs = make_docs(rows, extra=True)
    small = {(r.doc_id, r.h): r.times for r in M.mix(docs, share=0.4).collect()}
    large = {(r.doc_id, r.h): r.times for r in M.mix(docs, share=0.9).collect()}
    assert all(large[k] >= v for k, v in small.items())
    again = {(r.doc_id, r.h): r.times for r in M.mix(docs.repartition(7), share=0.4).collect()}
    assert again == small
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(v for v in M.mix(docs).toPandas()["times"])
    assert M.mix(docs.limit(0)).collect() == [] and M.mixed_documents(docs.limit(0)).collect() == []
    empty = make_docs([(1, None), (2, "")])
    assert {r.times for r in M.mix(empty).collect()} == {0}
