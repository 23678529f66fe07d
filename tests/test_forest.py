"""Isolation forest: numpy pieces by hand, Spark plan against brute force."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from budgetlens.operators import anomalies as AN
from budgetlens.operators import forest as FO
from tests.conftest import make_facts


def test_c_factor_values():
    assert FO.c_factor(1) == 0.0
    assert FO.c_factor(2) == 1.0
    n = 256
    want = 2 * (math.log(n - 1) + FO.EULER_GAMMA) - 2 * (n - 1) / n
    assert abs(float(FO.c_factor(n)) - want) < 1e-12


def test_grow_tree_isolates_and_respects_depth():
    rng = FO.node_draws(42, "d", 0)
    X = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [5.0, 5.0]])
    feat, thr, left, right, val = FO.grow_tree(X, rng, max_depth=2)
    leaves = [i for i, f in enumerate(feat) if f < 0]
    assert all(left[i] == -1 and right[i] == -1 for i in leaves)
    assert max(val) <= 2 + float(FO.c_factor(4))
    # every point ends in exactly one leaf
    model = pd.DataFrame([("d", 0, 4, feat, thr, left, right, val)],
                         columns=[f.name for f in FO.MODEL_SCHEMA.fields])
    depth = FO.path_lengths(X, model)
    assert depth.shape == (4,) and np.all(depth > 0)


def test_constant_features_make_one_leaf():
    X = np.ones((50, 2))
    feat, thr, left, right, val = FO.grow_tree(X, FO.node_draws(42, "d", 1), 6)
    assert feat == [-1] and val == [float(FO.c_factor(50))]


def _facts_with_outliers(spark, n=300):
    rng = np.random.default_rng(7)
    rows = [{"Project_ID": f"P{i:04d}",
             "Utilization_Percentage": Decimal(str(round(float(rng.normal(100, 5)), 2))),
             "Delay_Days": int(rng.integers(5, 15))} for i in range(n - 2)]
    rows += [{"Project_ID": "OUT1", "Utilization_Percentage": Decimal("400.00"), "Delay_Days": 300},
             {"Project_ID": "OUT2", "Utilization_Percentage": Decimal("1.00"), "Delay_Days": 250}]
    return make_facts(spark, rows)


def test_planted_outliers_rank_first_and_contamination(spark):
    f = _facts_with_outliers(spark)
    ml = AN.ml_anomalies(f).orderBy(F.col("anomaly_score").desc()).collect()
    assert {r["Project_ID"] for r in ml[:2]} == {"OUT1", "OUT2"}
    assert len(ml) <= math.ceil(0.1 * 300) + 1
    kpi = AN.anomaly_kpis(f).first()
    assert kpi["total_records"] == 300 and kpi["ml_anomalies_found"] == len(ml)


def test_spark_scores_equal_brute_force(spark):
    """Score every row in pandas with the model Spark fitted, take numpy's
    linear 90th percentile over all rows, and compare the flagged sets."""
    f = _facts_with_outliers(spark)
    rows = FO.feature_rows(f)
    counts = AN.department_counts(f)
    model = FO.fit_forest(rows, counts).toPandas()
    pdf = rows.toPandas()
    X = pdf[["x0", "x1"]].to_numpy()
    score = FO.scores(FO.path_lengths(X, model.sort_values("tree")), int(model["psi"].iloc[0]))
    thr = np.percentile(score, 90)
    want = set(pdf["Project_ID"][score > thr])
    got = {r["Project_ID"] for r in AN.ml_anomalies(f).collect()}
    assert got == want


def test_model_does_not_depend_on_partitioning(spark):
    f = _facts_with_outliers(spark)
    a = {r["Project_ID"] for r in AN.ml_anomalies(f.repartition(1)).collect()}
    b = {r["Project_ID"] for r in AN.ml_anomalies(f.repartition(16)).collect()}
    assert a == b


def test_gate_small_departments(spark):
    rows = [{"Department": "Nine", "Project_ID": f"n{i}"} for i in range(9)]
    rows += [{"Department": "Ten", "Project_ID": f"t{i}"} for i in range(10)]
    f = make_facts(spark, rows)
    gate = {r["Department"]: (r["eligible"], r["message"]) for r in AN.anomaly_gate(f).collect()}
    assert gate["Nine"] == (False, AN.GATE_MESSAGE) and gate["Ten"] == (True, None)
    kpis = {r["Department"]: r["ml_anomalies_found"] for r in AN.anomaly_kpis(f).collect()}
    assert kpis["Nine"] == 0
    # all features equal in "Ten": one leaf per tree, equal scores, nothing flagged
    assert kpis["Ten"] == 0


def test_all_anomalies_ml_first_then_tagged(spark):
    f = _facts_with_outliers(spark).withColumn(
        "Anomaly_Tag", F.when(F.col("Project_ID") == "P0000", "High Risk").otherwise("Normal"))
    got = AN.all_anomalies(f, n=50).collect()
    sources = [r["source"] for r in got]
    assert sources == sorted(sources) and sources[-1] == 1
    assert got[-1]["Project_ID"] == "P0000"


def test_each_tree_draws_its_own_rows_of_the_whole_department(spark):
    rows = spark.range(6000).selectExpr("if(id < 5000, 'Large', 'Small') AS Department", "cast(id AS string) AS Project_ID",
                                        "cast(id % 97 AS double) AS x0", "cast(id % 13 AS double) AS x1")
    counts = rows.groupBy("Department").agg(F.count("*").alias("total"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        drawn = FO.drawn_rows(rows, counts, 100, 256, 42)
        got = drawn.toPandas()
        plan = drawn._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert (got.groupby(["Department", "tree"]).size() == 256).all() and len(got) == 2 * 100 * 256
    assert got[got.Department == "Large"].Project_ID.nunique() > 4800   # no pool: nearly every row is in some tree
    # what is dealt out by the department alone are counts, one row per task and department
    alone = [x for x in plan.splitlines() if "Exchange hashpartitioning(Department" in x and "tree" not in x]
    below = plan.splitlines()
    assert all("partial_count" in below[below.index(x) + 1] for x in alone)
    other = FO.drawn_rows(rows.repartition(7), counts, 100, 256, 42).toPandas()
    key = ["Department", "tree", "Project_ID"]
    assert got.sort_values(key)[key].values.tolist() == other.sort_values(key)[key].values.tolist()
