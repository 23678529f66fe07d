"""Active-entry Lloyd against plain Lloyd with Python integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from budgetlens.llm import activelloyd as al

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, rounds=al.ROUNDS):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max(4, -(-max((len(v) for _, v, _ in kept), default=0) // 4) * 4)
    w = dim // 4
    ints = [[max(-al.LIMIT, min(al.LIMIT, math.floor(1024 * x))) for x in v] + [0] * (dim - len(v)) for _, v, _ in kept]
    first = {}
    for (i, v, _), x in zip(kept, ints):
        if i is not None and (i not in first or v < first[i][0]):
            first[i] = (v, x)
    books = [[first[i][1][p * w:(p + 1) * w] for i in sorted(first)[:256]] for p in range(4)]

    def assign():
        out = []
        for x in ints:
            out.append([min((sum((a - b) ** 2 for a, b in zip(x[p * w:(p + 1) * w], e)), k) for k, e in enumerate(books[p])) for p in range(4)])
        return out
    for _ in range(rounds):
        near = assign()
        for p in range(4):
            for k in range(len(books[p])):
                own = [x[p * w:(p + 1) * w] for x, n in zip(ints, near) if n[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    near = assign()
    out = sorted(((i, label, "".join("%02x" % k for _, k in n), sum(d for d, _ in n)) for (i, _, label), n in zip(kept, near)), key=str)
    return out, books


def got(spark, rows):
    df, books = al.compressed(spark.createDataFrame(rows, SCHEMA).repartition(3))
    out = sorted(((r.vec_id, r.label, r.codes.hex(), r.error) for r in df.collect()), key=str)
    return out, [b.tolist() for b in books]


@pytest.mark.parametrize("seed,dim,spread", [(1, 8, 1.0), (2, 12, 0.003), (3, 4, 3000.0)])
def test_equals_plain_lloyd(spark, seed, dim, spread):
    """Few distinct values give many ties."""
    rng = np.random.default_rng(seed)
    rows = [(int(i) * 3, (np.round(rng.normal(size=dim), 1) * spread).tolist(), int(i) % 3) for i in range(400)]
    assert got(spark, rows) == brute(rows)


def test_edge_rows(spark):
    rows = [(5, [0.5, -0.5, 0.25, 1.0, 0.1], 1), (5, [0.5, -0.5, 0.25, 1.0, 0.1], 1), (5, [0.4, 0.0, 0.0, 0.0, 0.0], 2), (1, None, 1), (2, [0.1, None, 0.2], 1),
            (3, [float("nan")] * 5, 1), (4, [float("inf"), 0.0, 0.0, 0.0, 0.0], None), (None, [0.2] * 5, None), (7, [], 4), (8, [1e300, -1e300, 0.0, 0.0, 0.0], 4),
            (9, [16000.0, -16000.0, 1.0, 2.0, -0.00001], None)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) [0] == []
    blank, _ = got(spark, [(None, [1.0, 2.0], 1), (None, [1.0, 2.5], 1)])
    assert [r[2] for r in blank] == ["00000000"] * 2


def test_wide_integers_take_the_exact_path():
    rng = np.random.default_rng(0)
    x, e = rng.integers(-al.LIMIT, al.LIMIT, (50, 64)), rng.integers(-al.LIMIT, al.LIMIT, (256, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c)) for c in e] for r in x]
    assert al.distances(x, e).tolist() == want


def test_renewed_equals_full_scan_and_compares_moved_entries_only(monkeypatch):
    rng = np.random.default_rng(4)
    x, before = rng.integers(-6, 6, (3000, 3)), rng.integers(-6, 6, (40, 3))
    code, far = al.nearest(x, before)
    after, moved = before.copy(), np.zeros(40, bool)
    moved[[3, 17, 25]] = True
    after[moved] += rng.integers(1, 3, (3, 3))
    asked, plain = [], al.nearest
    monkeypatch.setattr(al, "nearest", lambda a, b: asked.append((len(a), len(b))) or plain(a, b))
    c, d = al.renewed(x, after, moved, code, far)
    want = plain(x, after)
    assert np.array_equal(c, want[0]) and np.array_equal(d, want[1])
    lost = int(moved[code].sum())
    assert asked == [(lost, 40), (3000 - lost, 3)]


def test_clashing_columns_and_hot_rows(spark):
    """A third of all rows are one vector and one label."""
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else [i * 0.01, -i * 0.02, 0.5, i % 7 * 1.0], 0 if i % 3 == 0 else i) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("codes", "error", "__ints", "__far", "__part", "__count"):
        df = df.withColumn(name, F.lit("x"))
    out, _ = al.compressed(df)
    assert out.columns.count("codes") == 1 and out.columns.count("error") == 1 and "__ints" in out.columns
    assert sorted(((r.vec_id, r.label, r.codes.hex(), r.error) for r in out.collect()), key=str) == brute(rows)[0]


def test_digest_order():
    books = [np.array([[1, -2], [3, 4]]), np.array([[5, 6]])]
    assert al.codebooks_digest(books) == hashlib.sha256(b"1,-2,3,4,5,6").hexdigest()
