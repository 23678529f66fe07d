"""One key holding a third of all rows: results stay whole and exact, and the
plans keep the hot key out of single-task windows or collections."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from budgetlens.operators import anomalies as AN
from budgetlens.operators import quality as Q
from budgetlens.operators import ranking as RK
from budgetlens.plans.inspect import plan_text
from tests.conftest import make_facts


def _skewed(spark, n=900):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(n):
        dept = "HOT" if i % 3 == 0 else f"D{i % 7}"
        rows.append({"Project_ID": f"P{i:05d}", "Department": dept,
                     "Utilization_Percentage": Decimal(str(round(float(rng.uniform(1, 200)), 2))),
                     "Delay_Days": int(rng.integers(0, 120))})
    return make_facts(spark, rows)


def test_top_per_department_hot_key_matches_brute_force(spark):
    f = _skewed(spark)
    got = {(r["Department"], r["rank"]): r["Project_ID"]
           for r in RK.top_per_department(f, 3).collect()}
    pdf = f.select("Department", "Project_ID", "Utilization_Percentage", "Delay_Days").toPandas()
    pdf["u"] = pdf["Utilization_Percentage"].astype(float)
    for dept, g in pdf.groupby("Department"):
        g = g.sort_values(["u", "Delay_Days", "Project_ID"], ascending=[True, False, True])
        for rank, pid in enumerate(g["Project_ID"].head(3), start=1):
            assert got[(dept, rank)] == pid
    assert "WindowGroupLimit" in plan_text(RK.top_per_department(f, 3))


def test_forest_pool_is_bounded_for_hot_department(spark):
    f = _skewed(spark, 1500)
    kpis = {r["Department"]: r for r in AN.anomaly_kpis(f).collect()}
    hot = kpis["HOT"]
    assert hot["total_records"] == 500
    # strict top 10% (+1 for ties at the interpolated threshold)
    assert 0 < hot["ml_anomalies_found"] <= 51


def test_duplicate_hot_key_is_flagged_whole(spark):
    rows = [{"Project_ID": "SAME"} for _ in range(300)] + \
           [{"Project_ID": f"U{i}"} for i in range(600)]
    f = make_facts(spark, rows)
    good, bad = Q.validate_rows(f)
    assert good.count() == 600 and bad.count() == 300
    text = plan_text(Q.checked_rows(f))            # the duplicate check is grouped
    assert "HashAggregate" in text and "partial_count" in text
    assert "Window" not in text
