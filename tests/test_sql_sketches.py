"""Reports as SQL with bound parameters; approximate distincts from sketches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from budgetlens.operators import aggregates as A
from budgetlens.operators import filters as FL
from budgetlens.operators import sketches as SK
from budgetlens.plans.sql_reports import name_views, sql_report
from tests.conftest import make_facts


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_sql_reports_equal_their_dataframe_form(spark, small_facts):
    name_views(facts=small_facts)
    pairs = [(sql_report(spark, "leakage", min_utilization=60, n=7), A.leakage(small_facts, 60, 7)),
             (sql_report(spark, "high_risk", threshold=20, delay=100), FL.high_risk(small_facts, 20, 100))]
    dept = small_facts.agg(F.min("Department")).first()[0]
    pairs.append((sql_report(spark, "department", department=dept), A.department_summary(small_facts, dept)))
    for got, want in pairs:
        assert got.dtypes == want.dtypes and _rows(got) == _rows(want) and got.count() > 0


def test_values_are_never_sql(spark):
    odd = "x'; DROP VIEW facts; SELECT '\" OR 1=1 --"
    name_views(facts=make_facts(spark, [{"Department": odd, "State": "S7"}, {"Department": "Health"}]))
    assert [r["State"] for r in sql_report(spark, "department", department=odd).collect()] == ["S7"]
    assert sql_report(spark, "department", department="x' OR 'a'='a").count() == 0
    assert sql_report(spark, "department", department=None).count() == 0
    assert sql_report(spark, "SELECT State FROM facts WHERE Department = :d", d=odd).collect()[0]["State"] == "S7"
    with pytest.raises(ValueError):
        sql_report(spark, "department")
    with pytest.raises(ValueError):
        sql_report(spark, "leakage", limit=3)


def test_sql_parameters_reach_the_scan(spark, small_facts):
    name_views(facts=small_facts)
    plan = sql_report(spark, "department", department="Health")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Department" in plan


def test_sketches_merge_to_any_slice_within_bound(spark):
    ids = spark.range(60_000)
    f = ids.select(F.concat(F.lit("P"), (F.col("id") % 45_000).cast("string")).alias("Project_ID"),
                   F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("D"), (F.col("id") % 20).cast("string"))).alias("Department"),
                   (F.lit(2000) + (F.col("id") % 4).cast("int")).alias("Year"),
                   F.when(F.col("id") % 5 > 0, F.concat(F.lit("S"), (F.col("id") % 30).cast("string"))).alias("State"))
    counted = ["Project_ID", "State"]
    # two deliveries, reduced apart
    sk = SK.distinct_sketches(f.where("id < 20000"), counted).unionByName(SK.distinct_sketches(f.where("id >= 20000"), counted))
    total = SK.approximate_distincts(sk).first()
    assert abs(total["approx_Project_ID"] - 45_000) <= 4 * SK.relative_error() * 45_000
    assert total["approx_State"] == f.select("State").where("State is not null").distinct().count()
    errors = SK.measured_distincts(f, sk, ["Department"], counted).collect()
    assert len(errors) == 2 * f.select("Department").distinct().count()
    assert max(r["error"] for r in errors) <= 5 * SK.relative_error()
    one = SK.approximate_distincts(sk, where=(F.col("Department") == "Hot") & (F.col("Year") == 2001)).first()
    exact = f.where("Department = 'Hot' and Year = 2001").select("Project_ID").distinct().count()
    assert abs(one["approx_Project_ID"] - exact) <= 5 * SK.relative_error() * exact
    none = SK.approximate_distincts(sk, where=F.col("Department") == "nowhere").first()
    assert none["approx_Project_ID"] == 0


def test_sketches_of_nulls_and_no_rows(spark):
    f = make_facts(spark, [{"Department": None, "State": None}, {"Department": None, "State": None}])
    got = {(r["Department"], r["counted"]): (r["exact"], r["approx"], r["error"])
           for r in SK.measured_distincts(f, SK.distinct_sketches(f), ["Department"]).collect()}
    assert got[(None, "State")] == (0, 0, 0.0) and got[(None, "Project_ID")] == (2, 2, 0.0)
    empty = SK.approximate_distincts(SK.distinct_sketches(f.limit(0)))
    assert empty.first()["approx_State"] == 0
