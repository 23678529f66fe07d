"""The registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Every callable reads the driver tables of ``sf_dir`` (or the fact table Spark
derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from budgetlens.functions.bands import (delay_band, risk_level, risk_score,
                                        risk_score_band, utilization_band)
from budgetlens.functions.numeric import mean, to_output
from budgetlens.functions.text import compact_amount, thousands_cr, truncate_label
from budgetlens.operators import anomalies as AN
from budgetlens.operators import dims as DM
from budgetlens.operators import aggregates as A
from budgetlens.operators import allocation as AL
from budgetlens.operators import filters as FL
from budgetlens.operators import incremental as IN
from budgetlens.operators import lists as L
from budgetlens.operators import ranking as RK
from budgetlens.operators import reallocate as R
from budgetlens.operators import quality as Q
from budgetlens.operators import sketches as SK
from budgetlens.plans.sql_reports import name_views, sql_report
from budgetlens.session import materialize, scratch_path
from budgetlens.sources.commits import load_facts, read_version
from budgetlens.sources.csv import clean_columns, raw_name, read_budget, write_budget_csv
from budgetlens.sources.sinks import to_records
from budgetlens.sources.star import budget_facts, facts, facts_path, read_facts, write_built
from budgetlens.sources.zones import ZONE_TABLE, Between, lookup, write_zones
from budgetlens.streaming import alerts as ST
from budgetlens.streaming import lifecycle as LC

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# --- J3 ---------------------------------------------------------------------

@register("budget_facts")
def _budget_facts(spark, d):
    return to_output(budget_facts(spark, d))


# --- A reports ----------------------------------------------------------------

@register("leakage")
def _leakage(spark, d):
    return A.leakage(facts(spark, d))


@register("summary")
def _summary(spark, d):
    return A.summary(facts(spark, d))


@register("department_summary")
def _department_summary(spark, d):
    return A.department_summary(facts(spark, d))


@register("underutilized")
def _underutilized(spark, d):
    return A.underutilized(facts(spark, d))


@register("overutilized")
def _overutilized(spark, d):
    return A.overutilized(facts(spark, d))


@register("state_summary")
def _state_summary(spark, d):
    return A.state_summary(facts(spark, d))


@register("department_rollup")
def _department_rollup(spark, d):
    return A.department_rollup(facts(spark, d))


@register("conditional_counts")
def _conditional_counts(spark, d):
    return A.conditional_counts(facts(spark, d))


def _one(f, column):
    """The smallest value of a column: a choice that the data makes."""
    row = f.where(F.col(column).isNotNull()).agg(F.min(column).alias("v")).first()
    return row["v"]


@register("department_one")
def _department_one(spark, d):
    f = facts(spark, d)
    return A.department_summary(f, _one(f, "Department"))


@register("state_one")
def _state_one(spark, d):
    f = facts(spark, d)
    return A.state_summary(f, _one(f, "State"))


@register("spend_share")
def _spend_share(spark, d):
    return A.spend_share(facts(spark, d))


@register("anomaly_counts")
def _anomaly_counts(spark, d):
    return A.anomaly_counts(facts(spark, d))


@register("anomaly_tag_kpis")
def _anomaly_tag_kpis(spark, d):
    return A.anomaly_tag_kpis(facts(spark, d))


@register("breakdown")
def _breakdown(spark, d):
    return A.breakdown(facts(spark, d))


@register("leakage_by_location")
def _leakage_by_location(spark, d):
    return A.leakage_by_location(facts(spark, d))


@register("context_stats")
def _context_stats(spark, d):
    return A.context_stats(facts(spark, d))


@register("development_trend")
def _development_trend(spark, d):
    return A.development_trend(facts(spark, d))


@register("development_axis")
def _development_axis(spark, d):
    return A.development_axis(facts(spark, d))


# --- D lists, L paging ----------------------------------------------------------

@register("list_states")
def _list_states(spark, d):
    return L.list_values(facts(spark, d), "State")


@register("list_ministries")
def _list_ministries(spark, d):
    return L.list_values(facts(spark, d), "Ministry")


@register("list_departments")
def _list_departments(spark, d):
    return L.list_values(facts(spark, d), "Department")


@register("list_districts")
def _list_districts(spark, d):
    return L.list_districts(facts(spark, d))


@register("page_more")
def _page_more(spark, d):
    return L.page_counts(A.state_summary(facts(spark, d)), 20)


# --- F filters ----------------------------------------------------------------

@register("high_risk")
def _high_risk(spark, d):
    return FL.high_risk(facts(spark, d))


@register("tagged_anomalies")
def _tagged_anomalies(spark, d):
    return to_output(FL.tagged_anomalies(facts(spark, d)).select(
        "Department", "Project_ID", "Anomaly_Tag", "Utilization_Percentage", "Delay_Days"))


# --- W, R ------------------------------------------------------------------------

@register("top_per_department")
def _top_per_department(spark, d):
    return RK.top_per_department(facts(spark, d), 5)


@register("reallocate")
def _reallocate(spark, d):
    return R.reallocate(facts(spark, d))


@register("reallocate_within_department")
def _reallocate_within_department(spark, d):
    return R.reallocate_within_department(facts(spark, d))


_STATES: dict[str, str] = {}


def _states(spark, d):
    """Report states after five deliveries of the facts (by md5 of the
    project), one of them twice: what it said first (twice the money, another
    State) is taken back by what it says then; one is removed and comes again."""
    path = facts_path(spark, d)
    if path not in _STATES:
        f = facts(spark, d)
        states = scratch_path(spark, "report-states")
        part = F.pmod(F.conv(F.substring(F.md5("Project_ID"), 1, 8), 16, 10).cast("bigint"), F.lit(5))
        deliveries = {f"delivery {i}": f.where(part == i) for i in range(5)}
        wrong = deliveries["delivery 2"].withColumns({
            "State": F.lit("elsewhere"), "Allocated_Budget_Cr": (F.col("Allocated_Budget_Cr") * 2).cast("decimal(18,2)")})
        IN.apply_delivery(wrong, states, "delivery 2")
        for name, rows in deliveries.items():
            IN.apply_delivery(rows, states, name)
        IN.remove_delivery(spark, states, "delivery 4")
        IN.apply_delivery(deliveries["delivery 4"], states, "delivery 4")
        _STATES[path] = states
    return IN.read_state(spark, _STATES[path])


@register("incremental_summary")
def _incremental_summary(spark, d):
    return IN.summary(_states(spark, d))


@register("incremental_departments")
def _incremental_departments(spark, d):
    return IN.department_summary(_states(spark, d))


@register("incremental_states")
def _incremental_states(spark, d):
    return IN.state_summary(_states(spark, d))


@register("incremental_context")
def _incremental_context(spark, d):
    return IN.context_stats(_states(spark, d))


@register("sketch_distincts")
def _sketch_distincts(spark, d):
    # exact counts per department beside the estimates from stored sketches: is
    # each within five standard errors?
    f = facts(spark, d)
    sketches = materialize(SK.distinct_sketches(f), "distinct-sketches")
    return SK.measured_distincts(f, sketches, ["Department"]).select(
        "Department", "counted", "exact", (F.col("error") <= 5 * SK.relative_error()).alias("within"))


# --- S11 reports as SQL with bound parameters ---------------------------------

@register("sql_leakage")
def _sql_leakage(spark, d):
    name_views(facts=facts(spark, d))
    return sql_report(spark, "leakage")


@register("sql_high_risk")
def _sql_high_risk(spark, d):
    name_views(facts=facts(spark, d))
    return sql_report(spark, "high_risk")


@register("sql_department")
def _sql_department(spark, d):
    f = facts(spark, d)
    name_views(facts=f)
    return sql_report(spark, "department", department=f.agg(F.min("Department")).first()[0])


@register("allocate_surplus")
def _allocate_surplus(spark, d):
    return AL.allocate_surplus(facts(spark, d))


# --- M anomalies (forest: rows-only check; gate, flag rule and risk score exact) --

@register("anomaly_gate")
def _anomaly_gate(spark, d):
    return AN.anomaly_gate(facts(spark, d))


_SCORED: dict[str, DataFrame] = {}


def _scored_points(spark, d):
    """Points scored by one fit per stored fact table, shared by the anomaly
    reports and written to the shared folder."""
    path = facts_path(spark, d)
    if path not in _SCORED:
        _SCORED[path] = materialize(AN.scored_points(facts(spark, d)), "scored-points")
    return _SCORED[path]


@register("ml_anomalies")
def _ml_anomalies(spark, d):
    return AN.ml_anomalies(facts(spark, d), _scored_points(spark, d))


@register("anomaly_kpis")
def _anomaly_kpis(spark, d):
    return AN.anomaly_kpis(facts(spark, d), _scored_points(spark, d))


@register("all_anomalies")
def _all_anomalies(spark, d):
    return AN.all_anomalies(facts(spark, d), scored=_scored_points(spark, d))


def _scored(spark, d):
    f = facts(spark, d)
    return f.select("Department", "Project_ID", risk_score().alias("risk_score"))


@register("risk_score")
def _risk_score(spark, d):
    return _scored(spark, d).withColumn("risk_band", risk_score_band("risk_score"))


@register("flag_by_contamination")
def _flag_by_contamination(spark, d):
    flagged = AN.flag_by_contamination(_scored(spark, d), ["Department"], "risk_score", 0.1)
    return flagged.filter("is_anomaly").select("Department", "Project_ID", "risk_score")


# --- F7-F9 bands, X text -------------------------------------------------------

@register("bands")
def _bands(spark, d):
    f = facts(spark, d)
    return f.select("Project_ID", utilization_band("Utilization_Percentage")
                    .alias("utilization_band"), delay_band("Delay_Days").alias("delay_band"))


@register("risk_level")
def _risk_level(spark, d):
    return facts(spark, d).select("Project_ID", risk_level().alias("risk_level"))


@register("label_truncate")
def _label_truncate(spark, d):
    # department labels of the web client's chart, over the distinct Scheme names
    f = facts(spark, d)
    return (f.select(F.concat_ws(" / ", "Department", "Scheme_Name").alias("name"))
            .distinct().select("name", truncate_label("name").alias("label")))


@register("compact_amount")
def _compact_amount(spark, d):
    # mobile client's short amounts, over each state's allocation in rupees
    # (1 crore = 1e7 rupees) and its project count
    f = facts(spark, d)
    g = f.groupBy("State").agg(F.sum("Allocated_Budget_Cr").alias("cr"),
                               F.count(F.lit(1)).alias("n"))
    rupees = F.col("cr") * F.lit(10_000_000)
    return g.select("State", compact_amount(rupees).alias("total_text"),
                    compact_amount(F.col("n")).alias("projects_text"),
                    thousands_cr("cr").alias("total_k_cr"))


# --- S ingest, quality, sinks ----------------------------------------------------

@register("ingest_csv")
def _ingest_csv(spark, d):
    # facts written as the source CSV would look (raw headers, 'NA' cells),
    # read back through the CSV reader with its cleaning and casts
    path = scratch_path(spark, "budget-csv")
    write_budget_csv(facts(spark, d), path)
    return to_output(read_budget(spark, path))


@register("clean_columns")
def _clean_columns(spark, d):
    f = facts(spark, d)
    raw = f.toDF(*[raw_name(c) for c in f.columns])
    return to_output(clean_columns(raw))


@register("ingest_roundtrip")
def _ingest_roundtrip(spark, d):
    path = write_built(spark, d, scratch_path(spark, "facts-copy"))
    return to_output(read_facts(spark, path))


_ZONED: dict[str, str] = {}


def _zones_path(spark, d):
    """The facts in zones, written once per stored fact table."""
    path = facts_path(spark, d)
    if path not in _ZONED:
        _ZONED[path] = write_zones(facts(spark, d), scratch_path(spark, "zones"))
    return _ZONED[path]


@register("zone_lookups")
def _zone_lookups(spark, d):
    path = _zones_path(spark, d)
    ends = spark.read.parquet(f"{path}/{ZONE_TABLE}").agg(*[x for c in ("State", "District", "Ministry", "Department", "Year") for x in (
        F.min(f"{c}_lo").alias(f"{c}_first"), F.max(f"{c}_hi").alias(f"{c}_last"))]).first()
    asked = {
        "state and utilization": {"State": ends["State_first"], "Utilization_Percentage": Between(None, 30)},
        "department and year": {"Department": ends["Department_first"], "Year": ends["Year_last"]},
        "district and ministry": {"District": ends["District_last"], "Ministry": ends["Ministry_first"]},
        "high utilization": {"Utilization_Percentage": Between(150, None)},
        "two states in a year": {"State": [ends["State_first"], ends["State_last"]], "Year": ends["Year_first"]},
    }
    out = None
    for name, wanted in asked.items():
        one = lookup(spark, path, **wanted).agg(
            F.lit(name).alias("lookup"), F.count(F.lit(1)).alias("projects"), F.countDistinct("Project_ID").alias("project_ids"),
            F.sum("Allocated_Budget_Cr").alias("allocated"), F.min("Utilization_Percentage").alias("lowest"), F.max("Utilization_Percentage").alias("highest"))
        out = one if out is None else out.unionByName(one)
    return to_output(out)


@register("commit_loads")
def _commit_loads(spark, d):
    # four loads into one table, each allowed 2 % of bad rows: the facts; the
    # facts with negative money in one year (too many bad rows: refused); an
    # upload without a column (refused); the facts, negative in the largest
    # department of one quarter of that year only if few (accepted or refused by its share)
    f = facts(spark, d)
    root = scratch_path(spark, "committed")
    year = f.agg(F.max("Year")).first()[0]
    broken = (F.col("Year") == year)
    few = broken & (F.col("Quarter") == "Q1") & (F.col("State") == f.agg(F.min("State")).first()[0])
    loads = {"facts": f, "a bad year": f.withColumn("Actual_Spending_Cr", F.when(broken, -F.lit(1)).otherwise(F.col("Actual_Spending_Cr")).cast("decimal(18,4)")),
             "no column": f.drop("Utilization_Percentage"),
             "a few bad rows": f.withColumn("Actual_Spending_Cr", F.when(few, -F.lit(1)).otherwise(F.col("Actual_Spending_Cr")).cast("decimal(18,4)"))}
    out = None
    for name, df in loads.items():
        done = load_facts(df, root, max_bad_share=0.02)
        # what a reader sees after the load
        seen = read_version(spark, root).agg(
            F.lit(name).alias("load"), F.lit(done.accepted).alias("accepted"), F.lit(done.version).cast("long").alias("version"),
            F.lit(done.records).cast("long").alias("records"), F.lit(done.bad).cast("long").alias("bad"),
            F.count(F.lit(1)).alias("rows_seen"), F.sum("Actual_Spending_Cr").alias("spent_seen"), F.max("Year").alias("last_year"))
        out = seen if out is None else out.unionByName(seen)
    return to_output(out)


@register("ingest_stats")
def _ingest_stats(spark, d):
    return Q.ingest_stats(facts(spark, d))


@register("quarantine")
def _quarantine(spark, d):
    return Q.quarantine_summary(facts(spark, d))


@register("profile_numeric")
def _profile_numeric(spark, d):
    return Q.profile_numeric(facts(spark, d))


@register("health")
def _health(spark, d):
    return Q.health(spark, facts_path(spark, d))


@register("first_projects")
def _first_projects(spark, d):
    return to_output(Q.head(facts(spark, d), 5))


@register("ingest_many_csv")
def _ingest_many_csv(spark, d):
    # one file set per year with the columns in another order, read as one
    # table; Year is checked against the folder a row came from
    f = facts(spark, d)
    years = [r[0] for r in f.select("Year").distinct().orderBy("Year").collect()]  # calendar years
    paths = []
    for i, y in enumerate(years):
        paths.append(scratch_path(spark, f"csv-{y}"))
        order = f.columns[i % 3:] + f.columns[: i % 3]
        write_budget_csv(f.where(F.col("Year") == y).select(*order), paths[-1])
    back = read_budget(spark, paths, with_source=True, multi_line=False)
    return to_output(back.groupBy("Year", "State").agg(
        F.count(F.lit(1)).alias("projects"), F.sum("Allocated_Budget_Cr").alias("allocated"),
        F.count_if(F.col("Source_File").endswith(".csv")).alias("with_source")))


@register("json_records")
def _json_records(spark, d):
    # the JSON text read back with the declared schema
    report = A.leakage(facts(spark, d))
    return to_records(report).select(F.from_json("record", report.schema).alias("r")).select("r.*")


# --- T alerts ----------------------------------------------------------------------

@register("alert_candidates")
def _alert_candidates(spark, d):
    return ST.alert_candidates(facts(spark, d))


def _period_alerts(spark, d):
    # batch alerts stamped with the project's period (first day of its month)
    # instead of the wall clock, so the view is repeatable
    c = ST.alert_candidates(facts(spark, d), keep=["Year", "Month"])
    return (c.withColumn("timestamp", F.make_date("Year", "Month", F.lit(1)).cast("timestamp"))
            .withColumn("alert_id", F.col("Project_ID")).drop("Year", "Month"))


@register("alert_view")
def _alert_view(spark, d):
    v = ST.alert_view(_period_alerts(spark, d))
    return v.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))


@register("alert_unread")
def _alert_unread(spark, d):
    return ST.alert_unread(_period_alerts(spark, d))


#: Deliveries of fact files in which the alert job sees the facts.
DELIVERIES = 4


@register("alert_stream")
def _alert_stream(spark, d):
    # the facts arrive in deliveries (by md5 of the project), and the job runs
    # to the end of what is there after each: delivery i is micro-batch i
    f = facts(spark, d)
    src, sink, ckpt = (scratch_path(spark, n) for n in ("alert-source", "alerts", "alerts-ckpt"))
    delivery = F.pmod(F.conv(F.substring(F.md5("Project_ID"), 1, 8), 16, 10).cast("bigint"), F.lit(DELIVERIES))
    for i in range(DELIVERIES):
        f.where(delivery == i).write.mode("append").parquet(src)
        ST.alert_stream(ST.read_fact_stream(spark, src), sink, ckpt, available_now=True).awaitTermination()
    return ST.read_alerts(spark, sink).drop("timestamp")


#: What the alert lifecycle follows: the mean utilization of a scheme in a district.
READING_KEYS = ["State", "District", "Scheme_Name"]


@register("alert_lifecycle")
def _alert_lifecycle(spark, d):
    # a reading per scheme, district and quarter; two years make a delivery, and
    # the job runs to the end of what is there after each
    f = facts(spark, d)
    month = F.substring("Quarter", 2, 1).cast("int") * 3 - 2
    readings = materialize(f.groupBy(*READING_KEYS, "Year", "Quarter").agg(
        mean(F.sum("Utilization_Percentage"), F.count("Utilization_Percentage")).alias("utilization")).select(
        *READING_KEYS, F.make_date("Year", month, F.lit(1)).cast("timestamp").alias("at"), "utilization",
        F.floor(F.col("Year") / 2).alias("_part")), "readings")
    src, sink, ckpt = (scratch_path(spark, n) for n in ("alert-readings", "alert-events", "alerts-ckpt"))
    for part in [r[0] for r in readings.select("_part").distinct().orderBy("_part").collect()]:
        readings.where(F.col("_part").eqNullSafe(part)).drop("_part").write.mode("append").parquet(src)
        stream = spark.readStream.schema(readings.drop("_part").schema).parquet(src)
        LC.start_lifecycle(stream, READING_KEYS, sink, ckpt, available_now=True, recovered=40.0).awaitTermination()
    events = LC.read_events(spark, sink, [readings.schema[k] for k in READING_KEYS])
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return events.select(*READING_KEYS, "kind", stamp("at"), stamp("since"), "utilization")


# --- F5 scope, D4-D6 user dimension (derived from the facts' departments) ----------

def _first_department_user(f):
    first = L.list_values(f.filter(F.col("Department").isNotNull()), "Department").first()
    return None if first is None else first["Department"]


@register("scoped_rows")
def _scoped_rows(spark, d):
    f = facts(spark, d)
    ents = DM.entitlements_from_facts(f)
    dept = _first_department_user(f)
    user = (ents.filter(F.col("department") == F.lit(dept)).select("username").first()
            if dept is not None else None)
    rows = FL.scope_rows(f, ents, user["username"] if user else None, "anomalies")
    return to_output(rows.select("Project_ID", "Department", "State",
                                 "Utilization_Percentage"))


@register("scope_counts")
def _scope_counts(spark, d):
    f = facts(spark, d)
    return FL.scope_counts(f, DM.entitlements_from_facts(f), "anomalies")


@register("dim_upsert")
def _dim_upsert(spark, d):
    f = facts(spark, d)
    target = DM.entitlements_from_facts(f)
    renamed = target.filter(F.col("role") == "department").withColumn(
        "full_name", F.concat(F.initcap("department"), F.lit(" Head")))
    ministries = f.select("Ministry").distinct().select(
        F.concat(F.lower(F.regexp_replace("Ministry", "[^A-Za-z0-9]+", "_")), F.lit("_min"))
        .alias("username"),
        F.lit(None).cast("string").alias("email"), F.col("Ministry").alias("full_name"),
        F.lit("public").alias("role"), F.lit(None).cast("string").alias("department"),
        F.lit(False).alias("disabled"))
    return DM.upsert(target, renamed.unionByName(ministries), ["username"], ["full_name"])


@register("dim_update")
def _dim_update(spark, d):
    f = facts(spark, d)
    ents = DM.entitlements_from_facts(f)
    overspent = (f.groupBy("Department").agg(F.sum("Remaining_Budget_Cr").alias("r"))
                 .filter(F.col("r") < 0)
                 .select(DM.department_username("Department").alias("username")))
    return DM.update_where_in(ents, "username", overspent, "disabled", True)


@register("dim_append")
def _dim_append(spark, d):
    f = facts(spark, d)
    target = DM.entitlements_from_facts(f)
    slug = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"))
    by_scheme = f.select("Ministry", "Scheme_Name").distinct().select(
        F.concat(slug("Ministry"), F.lit("_min")).alias("username"),
        F.concat(slug("Ministry"), F.lit("."), slug("Scheme_Name"), F.lit("@gov.in"))
        .alias("email"),
        F.col("Ministry").alias("full_name"), F.lit("public").alias("role"),
        F.lit(None).cast("string").alias("department"), F.lit(False).alias("disabled"))
    again = f.select("Department").distinct().select(
        DM.department_username("Department").alias("username"),
        F.lit(None).cast("string").alias("email"), F.col("Department").alias("full_name"),
        F.lit("department").alias("role"), F.col("Department").alias("department"),
        F.lit(False).alias("disabled"))
    by_state = f.select("State").distinct().select(
        F.concat(slug("State"), F.lit("_public")).alias("username"),
        F.lit("public@citizen.in").alias("email"), F.col("State").alias("full_name"),
        F.lit("public").alias("role"), F.lit(None).cast("string").alias("department"),
        F.lit(False).alias("disabled"))
    # identical rows, and a row whose e-mail stands in a rejected one
    odd = spark.createDataFrame([
        ("zz_twin", "twin@gov.in", "Twin", "public", None, False), ("zz_twin", "twin@gov.in", "Twin", "public", None, False),
        ("admin", "chain@gov.in", "Chain", "public", None, False), ("zz_chain", "chain@gov.in", "Chain", "public", None, False),
        ("zz_late", "twin@gov.in", "Late", "public", None, False)], DM.USER_DDL)
    snapshot, rejected = DM.append_new(target, by_scheme.unionByName(again).unionByName(by_state).unionByName(odd))
    return snapshot.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)
