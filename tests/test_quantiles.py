"""Exact distributed percentiles against numpy (linear interpolation)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from budgetlens.operators import quantiles as QQ
from budgetlens.operators.quantiles import exact_percentiles

QS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def _numpy(values, weights, q):
    return float(np.percentile(np.repeat(values, weights), q * 100))


@pytest.mark.parametrize("digit", [3, 11])
def test_matches_numpy_weighted(spark, monkeypatch, digit):
    monkeypatch.setattr(QQ, "DIGIT", digit)
    rng = np.random.default_rng(3)
    rows = []
    for g in ("a", "b", "c"):
        vals = rng.integers(0, 40, size=200).astype(float) / 4
        wts = rng.integers(1, 5, size=200)
        rows += [(g, float(v), int(w)) for v, w in zip(vals, wts)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", QS, "w").collect()}
    for g in ("a", "b", "c"):
        sub = [(v, w) for gg, v, w in rows if gg == g]
        vals = np.array([v for v, _ in sub])
        wts = np.array([w for _, w in sub])
        for i, q in enumerate(QS):
            assert got[g][f"p_{i}"] == pytest.approx(_numpy(vals, wts, q), abs=1e-12)
        assert got[g]["n"] == wts.sum()


def test_global_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (2.0,)], "v double")
    r = exact_percentiles(df, [], "v", [0.5, 0.25]).first()
    assert r["p_0"] == 2.0 and r["p_1"] == 1.5 and r["n"] == 3


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=40),
       st.sampled_from([0.1, 0.5, 0.9]))
def test_property_unweighted(spark, values, q):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    r = exact_percentiles(df, [], "v", [q]).first()
    assert r["p_0"] == pytest.approx(float(np.percentile(values, q * 100)), abs=1e-9)


def test_a_million_distinct_values_without_a_group_window(spark):
    df = spark.range(1_000_000).selectExpr("'g' AS g", "cast((id * 7919) % 1000003 as double) / 7 AS v")
    plan = exact_percentiles(df, ["g"], "v", [0.1, 0.5, 0.9])
    values = np.sort((np.arange(1_000_000) * 7919) % 1000003 / 7)
    r = plan.first()
    for i, q in enumerate([0.1, 0.5, 0.9]):
        assert r[f"p_{i}"] == pytest.approx(float(np.percentile(values, q * 100)), abs=1e-9)
    assert "Window" not in plan._jdf.queryExecution().toString()


def test_decimals_null_groups_and_nothing(spark):
    df = spark.createDataFrame([(None, "1.25"), (None, "2.50"), ("a", None), ("b", "7.00")], "g string, t string").selectExpr(
        "g", "cast(t as decimal(10,2)) AS v")
    got = {r["g"]: r["p_0"] for r in exact_percentiles(df, ["g"], "v", [0.5]).collect()}
    assert got == {None: 1.875, "b": 7.0}
    assert exact_percentiles(df.where("g = 'a'"), ["g"], "v", [0.5]).collect() == []


def _passes(monkeypatch):
    made = []
    plain = QQ.materialize
    monkeypatch.setattr(QQ, "materialize", lambda df, name: made.append(name) or plain(df, name))
    return made


def test_any_doubles_end_in_a_few_passes(spark, monkeypatch):
    """Infinities, the largest and the smallest doubles, both zeros."""
    made = _passes(monkeypatch)
    inf, big, tiny = float("inf"), 1.7e308, 5e-324
    rng = np.random.default_rng(2)
    values = [-inf, inf, -big, big, tiny, -tiny, 0.0, -0.0, 2 * tiny, 1e-300, -1e-310, float("nan"), None] + np.exp(rng.normal(size=60) * 300).clip(1e-300, 1e300).tolist()
    df = spark.createDataFrame([("g", v) for v in values] + [("low", -inf)] * 30 + [("low", float(i)) for i in range(31)], "g string, v double")
    real = np.sort([v for v in values if v is not None and v == v])
    n = len(real)
    qs = [i / (n - 1) for i in range(n)]
    got = {r.g: r for r in exact_percentiles(df, ["g"], "v", qs).collect()}
    for i in range(n):
        k = qs[i] * (n - 1)
        if k == int(k):
            assert got["g"][f"p_{i}"] == real[int(k)]
    assert made.count("quantile-brackets") <= 1 + -(-64 // QQ.DIGIT)
    assert QQ.column_quantiles(df.where("g = 'g'"), ["v"], qs)["v"] == [got["g"][f"p_{i}"] for i in range(n)]
    assert exact_percentiles(df.where("g = 'low'"), ["g"], "v", [0.0, 0.49, 0.5, 1.0]).first()[1:5] == (-inf, -inf, 0.0, 30.0)
    pair = spark.createDataFrame([(-inf,), (inf,)], "v double")
    assert exact_percentiles(pair, [], "v", [0.0, 0.5, 1.0]).first()[:3] == (-inf, None, inf)
    far = spark.createDataFrame([(-big,), (big,)], "v double")
    assert exact_percentiles(far, [], "v", [0.5]).first()[0] == 0.0


def test_integers_floats_and_wide_decimals(spark):
    df = spark.createDataFrame([(2**62 + i, float(i), f"{10**25 + i}.5") for i in range(5)], "a long, b float, c string").selectExpr("a", "b", "cast(c as decimal(38,2)) AS c", "cast(a as int) AS d")
    assert exact_percentiles(df, [], "a", [0.5]).first()[0] == float(2**62 + 2)
    assert exact_percentiles(df, [], "b", [0.5, 0.125]).first()[:2] == (2.0, 0.5)
    assert exact_percentiles(df, [], "c", [0.5]).first()[0] == 1e25 + 2.5


def test_profile_of_odd_columns(spark):
    """Small decimals keep their digits; wide spreads, infinities and integers."""
    from budgetlens.operators.quality import profile_numeric
    rows = [("0.000012", 10**18, float("-inf"), "1"), ("0.000049", -10**18, 1.0, "99999999999999999999.99"), ("0.000031", 7, 2.0, None)]
    df = spark.createDataFrame(rows, "a string, b long, c double, d string").selectExpr("cast(a as decimal(18,8)) AS a", "b", "c", "cast(d as decimal(30,2)) AS d", "cast(null as int) AS e")
    p = {r.column: r for r in profile_numeric(df).collect()}
    assert p["a"].std == pytest.approx(np.std([12e-6, 49e-6, 31e-6], ddof=1), rel=1e-12) and p["a"].p50 == 0.000031 and p["a"].p25 == 0.0000215
    assert p["b"].std == pytest.approx(np.std([1e18, -1e18, 7], ddof=1), rel=1e-11) and p["b"].p50 == 7.0
    assert (p["c"].min, p["c"].p25, p["c"].p50, p["c"].max) == (float("-inf"), float("-inf"), 1.0, 2.0)
    assert p["d"]["count"] == 2 and p["d"].p50 == pytest.approx(5e19, rel=1e-15) and p["d"].std == pytest.approx(1e20 / 2**0.5, rel=1e-11)
    assert p["e"]["count"] == 0 and p["e"].p50 is None


def test_keys_are_the_order_of_doubles():
    rng = np.random.default_rng(7)
    x = np.concatenate((rng.integers(-(1 << 63), (1 << 63) - 1, 4000).view(np.float64), 2.0 ** np.arange(-1074, 1024), [0.0, -0.0, np.inf, -np.inf, 1.7976931348623157e308]))
    x = x[~np.isnan(x)]
    keys = QQ._arrow_keys(pa.array(x))
    order = np.argsort(keys, kind="stable")
    assert np.all(np.diff(x[order]) >= 0) and len(np.unique(keys)) == len(np.unique(x))
    assert [QQ._value(int(k), T.DoubleType()) for k in keys] == x.tolist()
