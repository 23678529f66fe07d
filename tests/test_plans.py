"""Plan checks: pushdown, pruning, top-k, per-group limits, one scan per report."""

from __future__ import annotations

from pyspark.sql import functions as F

from budgetlens.operators import aggregates as A
from budgetlens.operators import filters as FL
from budgetlens.operators import ranking as RK
from budgetlens.operators import reallocate as R
from budgetlens.plans.inspect import (count_nodes, partition_filters, plan_text,
                                      pushed_filters, read_schemas)
from budgetlens.sources.star import budget_facts
from tests.conftest import SF_SMALL


def test_high_risk_or_is_pushed_and_topk_fused(small_facts):
    df = FL.high_risk(small_facts)
    assert any("Or(LessThan(Utilization_Percentage" in p for p in pushed_filters(df))
    assert count_nodes(df, "TakeOrderedAndProject") == 1
    schema = read_schemas(df)[0]
    assert "Revised_Budget_Cr" not in schema and "Population_Covered" not in schema


def test_department_report_prunes_partitions(small_facts):
    df = A.department_summary(small_facts, "PROMO")
    assert any("Department" in p for p in partition_filters(df))


def test_state_filter_reaches_scan(small_facts):
    assert any("EqualTo(State," in p for p in pushed_filters(FL.for_state(small_facts, "X")))


def test_leakage_is_one_shuffle_and_topk(small_facts):
    df = A.leakage(small_facts)
    assert count_nodes(df, "Exchange") == 1
    assert count_nodes(df, "TakeOrderedAndProject") == 1
    assert "partial_sum" in plan_text(df)


def test_top_per_department_limits_before_shuffle(small_facts):
    tree = plan_text(RK.top_per_department(small_facts, 5)).split("\n\n")[0]
    lines = [ln.strip() for ln in tree.splitlines()]
    first_exchange = max(i for i, ln in enumerate(lines) if "Exchange" in ln)
    assert any("WindowGroupLimit" in ln for ln in lines[first_exchange + 1:])


def test_reallocate_scans_facts_once(small_facts):
    for df in (R.reallocate(small_facts), R.reallocate_within_department(small_facts)):
        assert count_nodes(df, "Scan parquet") == 1
        assert count_nodes(df, "Join") == 0


def test_summary_distinct_counts_run_on_groups(small_facts):
    tree = plan_text(A.summary(small_facts)).split("\n\n")[0]
    lines = [ln.strip() for ln in tree.splitlines()]
    expand = next(i for i, ln in enumerate(lines) if "Expand" in ln)
    # below the Expand: a complete aggregation over the facts first
    assert any("HashAggregate" in ln for ln in lines[expand + 1:])
    assert sum("Exchange" in ln for ln in lines[expand + 1:]) == 1


def test_fact_build_shuffles_the_big_join(spark):
    # line items and orders of this folder are over this bound, nation is under it
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        text = plan_text(budget_facts(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in text and "ShuffledHashJoin" not in text
    assert "BroadcastExchange" in text  # nation (and small sides) broadcast


def test_scan_prunes_columns_for_two_column_projection(small_facts):
    df = small_facts.select("State", "Utilization_Percentage").filter(F.col("State") == "x")
    schema = read_schemas(df)[0]
    assert schema == "struct<State:string,Utilization_Percentage:decimal(9,2)>"
