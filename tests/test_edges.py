"""Hand-made edge rows (FIXTURES section 5) for the reports and helpers."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from budgetlens.functions import bands as B
from budgetlens.functions import text as X
from budgetlens.operators import aggregates as A
from budgetlens.operators import filters as FL
from budgetlens.operators import lists as L
from budgetlens.operators import reallocate as R
from tests.conftest import make_facts


def test_summary_counts_bare_district_names(spark):
    f = make_facts(spark, [
        {"State": "S1", "District": "X"}, {"State": "S2", "District": "X"},
        {"State": "S2", "District": "Y", "Utilization_Percentage": Decimal("20.00")},
    ])
    r = A.summary(f).first()
    assert r["total_states"] == 2
    assert r["total_districts"] == 2          # 'X' in two states counts once
    assert r["critical_underspend"] == 1
    assert r["critical_overspend"] == 0


def test_summary_over_no_rows_is_one_row_of_nulls(spark):
    f = make_facts(spark, [{}]).filter(F.lit(False))
    r = A.summary(f).collect()
    assert len(r) == 1
    assert r[0]["total_states"] == 0
    assert r[0]["total_allocated_cr"] is None
    assert r[0]["critical_underspend"] is None


def test_conditional_counts_on_missing_department(spark):
    f = make_facts(spark, [{"Department": "Health"}])
    r = A.conditional_counts(f, "Nowhere").first()
    assert r["sum_case"] is None and r["count_case"] == 0 and r["records"] == 0


def test_two_anomaly_tests_differ_on_null_and_upper_normal(spark):
    tags = [None, "Normal", "NORMAL", "High Risk"]
    f = make_facts(spark, [{"Anomaly_Tag": t, "District": "D1"} for t in tags])
    sql_count = A.department_summary(f, "Health").first()["anomaly_count"]
    assert sql_count == 2                      # 'NORMAL' and 'High Risk'; NULL not counted
    tagged = FL.tagged_anomalies(f, "Health").collect()
    assert [r["Anomaly_Tag"] for r in tagged] == ["High Risk"]


def test_high_risk_three_valued_or(spark):
    f = make_facts(spark, [
        {"Project_ID": "a", "Utilization_Percentage": None, "Delay_Days": 91},
        {"Project_ID": "b", "Utilization_Percentage": None, "Delay_Days": None},
        {"Project_ID": "c", "Utilization_Percentage": Decimal("29.99"), "Delay_Days": None},
        {"Project_ID": "d", "Utilization_Percentage": Decimal("30.00"), "Delay_Days": 90},
    ])
    got = [r["Project_ID"] for r in FL.high_risk(f).collect()]
    assert got == ["a", "c"]                   # NULL util sorts first, as SQL ASC


def test_leakage_tie_break_by_keys(spark):
    rows = [{"State": s, "Allocated_Budget_Cr": 100, "Actual_Spending_Cr": 10}
            for s in ("S2", "S1", "S3")]
    f = make_facts(spark, rows)
    got = A.leakage(f, n=2).collect()
    assert [r["State"] for r in got] == ["S1", "S2"]
    assert got[0]["unspent_amount"] == 90.0 and got[0]["record_count"] == 1


def test_underutilized_equal_surplus_ties(spark):
    rows = [{"District": d, "Allocated_Budget_Cr": 100, "Actual_Spending_Cr": 20}
            for d in ("D9", "D3")]
    got = A.underutilized(make_facts(spark, rows), n=1).collect()
    assert [r["District"] for r in got] == ["D3"]


def test_reallocate_third_arm_and_rank_zip(spark):
    # under: one Health group; over: a Health group whose mean util > 130 but
    # whose deficit <= 0 (a big under-spent row and small over-spent rows)
    rows = [
        {"District": "U1", "Allocated_Budget_Cr": 100, "Actual_Spending_Cr": 10},
        {"District": "O1", "Allocated_Budget_Cr": 1000, "Actual_Spending_Cr": 100},
        {"District": "O1", "Allocated_Budget_Cr": 1, "Actual_Spending_Cr": 3},
        {"District": "O1", "Allocated_Budget_Cr": 1, "Actual_Spending_Cr": 3},
        {"District": "O1", "Allocated_Budget_Cr": 1, "Actual_Spending_Cr": 3},
    ]
    f = make_facts(spark, rows)
    got = R.reallocate(f).collect()
    assert len(got) == 1
    r = got[0]
    assert r["from_location"] == "U1, S1" and r["to_location"] == "O1, S1"
    # deficit = 109 - 1003 < 0 -> min(0.7 * 90, 0.3 * 90) = 27
    assert r["suggested_amount_cr"] == 27.0
    assert r["current_utilization_from"] == "10.0%"


def test_reallocate_drops_rank_mismatch_within_department_keeps(spark):
    rows = [
        {"District": "U1", "Department": "A", "Allocated_Budget_Cr": 100, "Actual_Spending_Cr": 10},
        {"District": "U2", "Department": "B", "Allocated_Budget_Cr": 50, "Actual_Spending_Cr": 5},
        {"District": "O1", "Department": "B", "Allocated_Budget_Cr": 100, "Actual_Spending_Cr": 200},
        {"District": "O2", "Department": "A", "Allocated_Budget_Cr": 10, "Actual_Spending_Cr": 20},
    ]
    f = make_facts(spark, rows)
    assert R.reallocate(f).count() == 0        # rank 1: A vs B, rank 2: B vs A
    within = R.reallocate_within_department(f).collect()
    assert sorted((r["Department"], r["from_district"], r["to_district"]) for r in within) == [
        ("A", "U1", "O2"), ("B", "U2", "O1")]
    amounts = {r["Department"]: r["suggested_amount"] for r in within}
    assert amounts == {"A": 5.0, "B": 31.5}    # min(63, 5); min(31.5, 50)


def test_department_rollup_mean_of_means_null_as_zero(spark):
    rows = [
        {"District": "D1", "Utilization_Percentage": Decimal("10.00")},
        {"District": "D1", "Utilization_Percentage": Decimal("30.00")},
        {"District": "D1", "Utilization_Percentage": Decimal("50.00")},
        {"District": "D2", "Utilization_Percentage": Decimal("90.00")},
        {"District": "D3", "Utilization_Percentage": None},
    ]
    r = A.department_rollup(make_facts(spark, rows), "S1").first()
    # group means 30, 90, NULL -> (30 + 90 + 0) / 3 = 40 (not the row mean 45)
    assert r["utilization"] == 40.0 and r["district_rows"] == 3


def test_department_rollup_sums_equal_state_summary(spark, small_facts):
    s = A.state_summary(small_facts).agg(F.sum("allocated")).first()[0]
    r = A.department_rollup(small_facts).agg(F.sum("allocated")).first()[0]
    assert abs(s - r) < 1.0  # rollup rounds each department to 0.1


def test_lists_and_paging(spark, small_facts):
    states = [r[0] for r in L.list_values(small_facts, "State").collect()]
    assert states == sorted(states) and len(states) == 25
    c = L.page_counts(A.state_summary(small_facts), 20).first()
    assert c["shown"] == 20 and c["more"] == c["total"] - 20
    assert L.page(A.state_summary(small_facts), 5, ["utilization", "State"]).count() == 5


def test_fixed1_and_round_half_up(spark):
    df = spark.createDataFrame([(Decimal("2.675"), 12.25, Decimal("0.05"))],
                               "d decimal(10,3), x double, h decimal(10,2)")
    r = df.select(X.fixed1("x").alias("a"), X.round_half_up("d", 2).alias("b"),
                  X.fixed1("h").alias("c")).first()
    assert r["a"] == "12.3" and r["b"] == Decimal("2.68") and r["c"] == "0.1"


def test_text_helpers(spark):
    df = spark.createDataFrame([("Rural Development Board", 12_345_678.0, None)],
                               "name string, amount double, d string")
    r = df.select(X.truncate_label("name").alias("t"), X.compact_amount("amount").alias("c"),
                  X.location("d", "name").alias("loc"), X.thousands_cr(F.lit(12345)).alias("k")
                  ).first()
    assert r["t"] == "Rural Developme…"
    assert r["c"] == "1.2Cr"
    assert r["loc"] == "None, Rural Development Board"
    assert r["k"] == "12.3K Cr"


def test_bands_risk_levels_and_severity(spark):
    f = make_facts(spark, [
        {"Utilization_Percentage": Decimal("10.00"), "Delay_Days": 100},
        {"Utilization_Percentage": Decimal("130.00"), "Delay_Days": 5},
        {"Utilization_Percentage": None, "Delay_Days": None},
    ])
    got = f.select(B.utilization_band("Utilization_Percentage").alias("u"),
                   B.delay_band("Delay_Days").alias("d"), B.risk_level().alias("r"),
                   B.risk_score().alias("s")).collect()
    assert [(r["u"], r["d"], r["r"]) for r in got] == [
        ("low", "late", "High"), ("high", "on_time", "Low"), (None, None, "Low")]
    assert abs(got[0]["s"] - (0.5 * (20 / 30) + 0.3 * (100 / 180))) < 1e-12
    sev = spark.createDataFrame([("high",), ("LOW",), ("odd",), (None,)], "s string")
    assert [r[0] for r in sev.select(B.severity_rank("s")).collect()] == [3, 1, 0, 0]


def test_scope_rows_by_role(spark):
    f = make_facts(spark, [{"Department": "Health"}, {"Department": "Education"}])
    ents = spark.createDataFrame([
        ("admin", "a@x", None, "admin", None, False),
        ("health", "h@x", None, "department", "Health", False),
        ("pub", None, None, "public", None, False),
        ("old", None, None, "admin", None, True),
    ], "username string, email string, full_name string, role string, department string, "
       "disabled boolean")
    n = {u: FL.scope_rows(f, ents, u, "anomalies").count()
         for u in ("admin", "health", "pub", "old", "nobody")}
    assert n == {"admin": 2, "health": 1, "pub": 0, "old": 0, "nobody": 0}
    assert FL.scope_rows(f, ents, None, "summary").count() == 2
    assert FL.scope_rows(f, ents, "health", "leakage").count() == 0
    counts = {r["username"]: r["visible_rows"] for r in FL.scope_counts(f, ents).collect()}
    assert counts == {"admin": 2, "health": 1, "pub": 0, "old": 0}


def test_department_filter_on_layout_is_a_partition_filter(spark, small_facts):
    plan = small_facts.filter(F.col("Department") == "PROMO")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Department" in plan


def test_session_sizing_helpers(spark):
    from budgetlens.session import apply_defaults, size_shuffle_partitions
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffle_partitions(spark, 10 * (128 << 20)) >= 10
        assert size_shuffle_partitions(spark, 1) == 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert apply_defaults(spark).conf.get("spark.sql.adaptive.enabled") == "true"


def test_scratch_tables_go_with_their_scope(spark):
    import os

    from budgetlens.session import materialize, scratch_scope
    with scratch_scope(spark, keep=("facts-",)):
        a, b = materialize(spark.range(3), "gone"), materialize(spark.range(3), "facts")
        paths = [x.inputFiles()[0].removeprefix("file:").replace("///", "/").rsplit("/", 1)[0] for x in (a, b)]
        assert all(map(os.path.isdir, paths))
    assert not os.path.exists(paths[0]) and os.path.isdir(paths[1])
