import numpy as np
from pyspark.sql import functions as F

from budgetlens.llm import anntree as A
from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        s = np.zeros(len(x))
        for d in range(x.shape[1]):
            s += x[i, d] * x[:, d]
        o = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in o]
    return out


def test_query_recall_and_exact_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    got = {}
    for r in A.op2_ann_tree(spark, SF_SMALL).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(want)
    hits = [len({r.vec_id for r in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    score = {q: dict(v) for q, v in brute(rows, want, len(rows)).items()}
    for q, found in got.items():
        assert [r.rank for r in found] == list(range(1, 21))
        assert all(r.score == score[q][r.vec_id] for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)


def test_clusters_hot_vector_and_ties(spark, monkeypatch):
    monkeypatch.setattr(A, "BIN", 64)
    monkeypatch.setattr(A, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(0, 5) * 3 + rng.normal(0, 0.2, 8)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, [1.0] * 8) for i in range(400)]  # one vector many times
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    found = A.search(df, F.col("vec_id") % 20 == 0, 5, recall=1.0)
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 5)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    same = [got[q] == want[q] for q in want]
    assert set(got) == set(want) and np.mean(same) > 0.95


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (40, [0.0, 0.0]), (8, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = sorted(tuple(r) for r in A.search(df, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == [(0, 1, 1, 2.0), (0, 2, 8, 2.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 8, 0.0)]
    assert A.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert A.search(df.where("vec_id = 3"), F.col("vec_id") % 20 == 0).collect() == []
    assert A.search(df.where("vec_id = 1"), F.col("vec_id") % 20 == 0).collect() == []
    assert A.search(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).collect() == []


def test_double_vectors_keep_their_precision(spark):
    df = spark.createDataFrame([(0, [0.1, 0.2], 0), (1, [0.3, 0.7], 0)], "vec_id long, embedding array<double>, label int")
    assert A.search(df, F.col("vec_id") % 20 == 0).first().score == 0.1 * 0.3 + 0.2 * 0.7


def brute_once(rows, k):
    """Neighbours by vec_id, each once with its best score over all pairs of rows."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for q in sorted({i for i, _ in rows if i % 20 == 0}):
        best = {}
        for r in np.flatnonzero(ids == q):
            s = np.zeros(len(x))
            for d in range(x.shape[1]):
                s += x[r, d] * x[:, d]
            for i, score in zip(ids.tolist(), s.tolist()):
                if i != q:
                    best[i] = max(best.get(i, score), score)
        out[q] = sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k]
    return out


def searched(spark, rows, k):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = {}
    for r in A.search(df, F.col("vec_id") % 20 == 0, k, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_every_row_repeats(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 8).astype(np.float32).tolist()) for i in range(300)]
    got, want = searched(spark, rows * 3, 20), brute_once(rows, 20)
    assert np.mean([got[q] == want[q] for q in want]) > 0.95 and all(len(got[q]) == 20 for q in want)


def test_one_vec_id_repeats_with_many_vectors(spark, monkeypatch):
    monkeypatch.setattr(A, "BIN", 64)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(1, 0.3, 8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1001, rng.normal(2, 0.1, 8).astype(np.float32).tolist()) for _ in range(200)]  # near all queries
    got, want = searched(spark, rows, 10), brute_once(rows, 10)
    assert np.mean([got[q] == want[q] for q in want]) > 0.95
    assert all(len(got[q]) == 10 for q in want)


def test_small_clusters_give_all_queries_k_rows(spark):
    """70 clusters of 90 rows and 10 of 6: the first leaves of a query in a small
    cluster hold fewer than k others."""
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for c in range(80):
        centre = rng.normal(0, 10, 8)
        for _ in range(90 if c < 70 else 6):
            rows.append((i * 7919 % 6361, (centre + rng.normal(0, 0.01, 8)).astype(np.float32).tolist(), 0))
            i += 1
    df = spark.createDataFrame(rows, SCHEMA)
    n = {r.query_id: r["count"] for r in A.search(df, F.col("vec_id") % 20 == 0, 20).groupBy("query_id").count().collect()}
    queries = {r[0] for r in rows if r[0] % 20 == 0}
    assert set(n) == queries and set(n.values()) == {20}
    got, want = searched(spark, [r[:2] for r in rows], 20), brute_once([r[:2] for r in rows], 20)
    found = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert found >= 0.9 * sum(len(w) for w in want.values())
