"""The budget reports as grouped aggregations.

Every report is one plan over the fact DataFrame. Sums stay decimal until the
output cast; means are exact sum / non-null count. Group keys in the budget
hierarchy are low-cardinality, so where a report needs several distinct
counts or a roll-up, the facts are first reduced to one row per finest group
(partial aggregation happens map-side) and the distinct counts / roll-up run
on that small result instead of multiplying every fact row with ``Expand``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from budgetlens import schema as S
from budgetlens.functions.numeric import bigint, mean, to_output
from budgetlens.session import materialize

UTIL = "Utilization_Percentage"
ALLOC = "Allocated_Budget_Cr"
SPENT = "Actual_Spending_Cr"
REMAIN = "Remaining_Budget_Cr"
DELAY = "Delay_Days"
TAG = "Anomaly_Tag"


def _mean_util() -> Column:
    return mean(F.sum(UTIL), F.count(UTIL))


def _mean_delay() -> Column:
    return mean(F.sum(DELAY), F.count(DELAY))


def _sql_anomaly() -> Column:
    """The SQL reports' test: ``Anomaly_Tag != 'Normal'`` (NULL is not counted,
    case-sensitive, so 'NORMAL' counts)."""
    return F.col(TAG) != F.lit(S.NORMAL_TAG)


# ---------------------------------------------------------------------------
# A1 national summary

def summary(f: DataFrame, under: float = S.CRITICAL_UNDERSPEND,
            over: float = S.CRITICAL_OVERSPEND) -> DataFrame:
    """A1: distinct counts, totals, mean utilization, critical counts, waste.

    Two levels: one hash aggregation by (State, District, Ministry,
    Department) with map-side combine, then a global aggregation over those
    few groups that also takes the four distinct counts.
    """
    level1 = f.groupBy("State", "District", "Ministry", "Department").agg(
        F.sum(ALLOC).alias("a"), F.sum(SPENT).alias("s"),
        F.sum(UTIL).alias("u_sum"), F.count(UTIL).alias("u_n"),
        F.sum(F.when(F.col(UTIL) < under, 1).otherwise(0)).alias("lo"),
        F.sum(F.when(F.col(UTIL) > over, 1).otherwise(0)).alias("hi"),
    )
    out = level1.agg(
        F.countDistinct("State").alias("total_states"),
        F.countDistinct("District").alias("total_districts"),
        F.countDistinct("Ministry").alias("total_ministries"),
        F.countDistinct("Department").alias("total_departments"),
        F.sum("a").alias("total_allocated_cr"),
        F.sum("s").alias("total_spent_cr"),
        mean(F.sum("u_sum"), F.sum("u_n")).alias("avg_utilization"),
        bigint(F.sum("lo")).alias("critical_underspend"),
        bigint(F.sum("hi")).alias("critical_overspend"),
    ).withColumn("total_waste_cr", F.col("total_allocated_cr") - F.col("total_spent_cr"))
    return to_output(out)


# ---------------------------------------------------------------------------
# A2 department summary

def department_summary(f: DataFrame, department: str | None = None) -> DataFrame:
    """A2: per (State, District) of one department; all departments when None
    (then Department is a group key too). Ascending mean utilization."""
    keys = ["State", "District"]
    if department is not None:
        f = f.filter(F.col("Department") == F.lit(department))
    else:
        keys = ["Department"] + keys
    out = f.groupBy(*keys).agg(
        F.sum(ALLOC).alias("total_allocated"),
        F.sum(SPENT).alias("total_spent"),
        _mean_util().alias("avg_utilization"),
        F.sum(REMAIN).alias("total_remaining"),
        _mean_delay().alias("avg_delay"),
        F.count(F.when(_sql_anomaly(), 1)).alias("anomaly_count"),
    )
    return to_output(out.orderBy(F.col("avg_utilization").asc_nulls_first(), *keys))


# ---------------------------------------------------------------------------
# A3 leakage

LEAKAGE_KEYS = ["State", "District", "Ministry", "Department", "Scheme_Name"]


def leakage(f: DataFrame, min_utilization: float = S.LEAKAGE_MIN_UTILIZATION,
            n: int = S.LEAKAGE_LIMIT) -> DataFrame:
    """A3: five-level groups whose mean utilization is under the minimum,
    largest unspent first, top ``n`` (ties broken by the group keys)."""
    grouped = f.groupBy(*LEAKAGE_KEYS).agg(
        F.sum(ALLOC).alias("total_allocated"),
        F.sum(SPENT).alias("total_spent"),
        _mean_util().alias("avg_utilization"),
        F.sum(REMAIN).alias("unspent_amount"),
        _mean_delay().alias("avg_delay"),
        F.count(F.lit(1)).alias("record_count"),
    )
    out = (grouped.filter(F.col("avg_utilization") < F.lit(float(min_utilization)))
           .orderBy(F.col("unspent_amount").desc_nulls_last(), *LEAKAGE_KEYS)
           .limit(n))
    return to_output(out)


# ---------------------------------------------------------------------------
# A4 / A5 under- and over-utilised schemes (shared grouping)

SCHEME_KEYS = ["State", "District", "Department", "Scheme_Name"]


def scheme_groups(f: DataFrame) -> DataFrame:
    """The four-level grouping A4, A5, R3 and R4 share. Built by one function
    so the plans are identical and the shuffle exchange is reused."""
    return f.groupBy(*SCHEME_KEYS).agg(
        F.sum(ALLOC).alias("allocated"),
        _mean_util().alias("utilization"),
        F.sum(REMAIN).alias("surplus"),
        (F.sum(SPENT) - F.sum(ALLOC)).alias("deficit"),
    )


def _under(groups: DataFrame, threshold: float) -> DataFrame:
    return groups.filter(F.col("utilization") < F.lit(float(threshold)))


def _over(groups: DataFrame, threshold: float) -> DataFrame:
    return groups.filter(F.col("utilization") > F.lit(float(threshold)))


def underutilized_ranked(f: DataFrame, threshold: float = S.UNDER_UTILIZATION,
                         n: int = S.REALLOCATION_CANDIDATES) -> DataFrame:
    """A4 with its decimal columns, ordered by surplus desc then keys."""
    return (_under(scheme_groups(f), threshold)
            .select(*SCHEME_KEYS, "allocated", "utilization", "surplus")
            .orderBy(F.col("surplus").desc_nulls_last(), *SCHEME_KEYS).limit(n))


def overutilized_ranked(f: DataFrame, threshold: float = S.OVER_UTILIZATION,
                        n: int = S.REALLOCATION_CANDIDATES) -> DataFrame:
    """A5 with its decimal columns, ordered by deficit desc then keys."""
    return (_over(scheme_groups(f), threshold)
            .select(*SCHEME_KEYS, "allocated", "utilization", "deficit")
            .orderBy(F.col("deficit").desc_nulls_last(), *SCHEME_KEYS).limit(n))


def underutilized(f: DataFrame, threshold: float = S.UNDER_UTILIZATION,
                  n: int = S.REALLOCATION_CANDIDATES) -> DataFrame:
    """A4: mean utilization under ``threshold``, top ``n`` by surplus."""
    return to_output(underutilized_ranked(f, threshold, n))


def overutilized(f: DataFrame, threshold: float = S.OVER_UTILIZATION,
                 n: int = S.REALLOCATION_CANDIDATES) -> DataFrame:
    """A5: mean utilization over ``threshold``, top ``n`` by deficit."""
    return to_output(overutilized_ranked(f, threshold, n))


# ---------------------------------------------------------------------------
# A6 state summary, A9 department roll-up

def state_summary(f: DataFrame, state: str | None = None) -> DataFrame:
    """Per (District, Department) of one state; all states when None."""
    keys = ["District", "Department"]
    if state is not None:
        f = f.filter(F.col("State") == F.lit(state))
    else:
        keys = ["State"] + keys
    out = f.groupBy(*keys).agg(
        F.sum(ALLOC).alias("allocated"),
        F.sum(SPENT).alias("spent"),
        _mean_util().alias("utilization"),
        _mean_delay().alias("avg_delay"),
    )
    return to_output(out.orderBy(F.col("utilization").asc_nulls_first(), *keys))


def department_rollup(f: DataFrame, state: str | None = None) -> DataFrame:
    """The web client's roll-up of state rows to Department: sums of the
    group sums and the *mean of the group means* (a NULL mean counts as 0 and
    stays in the divisor), each rounded to one decimal."""
    keys = ["Department"] if state is not None else ["State", "Department"]
    if state is not None:
        f = f.filter(F.col("State") == F.lit(state))
    rows = f.groupBy(*(["State"] if state is None else []), "District", "Department").agg(
        F.sum(ALLOC).alias("allocated"), F.sum(SPENT).alias("spent"),
        _mean_util().alias("utilization"))
    out = rows.groupBy(*keys).agg(
        F.round(F.sum("allocated"), 1).alias("allocated"),
        F.round(F.sum("spent"), 1).alias("spent"),
        (F.sum(F.coalesce(F.col("utilization"), F.lit(0.0))) / F.count(F.lit(1)))
        .cast("decimal(18,1)").alias("utilization"),
        F.count(F.lit(1)).alias("district_rows"),
    )
    return to_output(out.orderBy(*keys))


# ---------------------------------------------------------------------------
# A8 conditional counts

def conditional_counts(f: DataFrame, department: str | None = None) -> DataFrame:
    """Both forms of conditional counting the reference uses.

    ``SUM(CASE .. THEN 1 ELSE 0 END)`` is NULL over no rows;
    ``COUNT(CASE .. THEN 1 END)`` is 0. With a department the result is one
    global row (so the empty case is visible); without, one row per department.
    """
    cond = _sql_anomaly()
    aggs = [bigint(F.sum(F.when(cond, 1).otherwise(0))).alias("sum_case"),
            F.count(F.when(cond, 1)).alias("count_case"),
            F.count(F.lit(1)).alias("records")]
    if department is not None:
        return f.filter(F.col("Department") == F.lit(department)).agg(*aggs)
    return f.groupBy("Department").agg(*aggs).orderBy("Department")


# ---------------------------------------------------------------------------
# A11-A16

def spend_share(f: DataFrame) -> DataFrame:
    """Two rows, Spent and Unspent, each with its share of the total."""
    tot = f.agg(F.coalesce(F.sum(SPENT), F.lit(0)).cast("double").alias("spent"),
                F.coalesce(F.sum(ALLOC) - F.sum(SPENT), F.lit(0)).cast("double")
                .alias("unspent"))
    rows = tot.select(F.expr(
        "stack(2, 'Spent', spent, try_divide(spent, spent + unspent),"
        " 'Unspent', unspent, try_divide(unspent, spent + unspent))"
        " AS (name, value, share)"))
    return rows


def anomaly_counts(f: DataFrame) -> DataFrame:
    """Rows per anomaly tag (NULL tag is its own group)."""
    return (f.groupBy(TAG).agg(F.count(F.lit(1)).alias("records"))
            .orderBy(F.col(TAG).asc_nulls_first()))


def breakdown(f: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """Totals by ministry / department / phase as a roll-up.

    The facts are reduced to the finest (dims) level first; the roll-up's
    ``Expand`` then runs over those few rows, not over every fact.
    """
    dims = dims or ["Ministry", "Department", "Quarter"]
    finest = f.groupBy(*dims).agg(
        F.sum(ALLOC).alias("a"), F.sum(SPENT).alias("s"),
        F.sum(UTIL).alias("u_sum"), F.count(UTIL).alias("u_n"),
        F.count(F.lit(1)).alias("n"))
    out = finest.rollup(*dims).agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("a").alias("allocated"), F.sum("s").alias("spent"),
        mean(F.sum("u_sum"), F.sum("u_n")).alias("avg_utilization"),
        bigint(F.sum("n")).alias("records"))
    return to_output(out.orderBy("level", *[F.col(d).asc_nulls_first() for d in dims]))


def leakage_by_location(f: DataFrame) -> DataFrame:
    """Unspent money and mean utilization per (State, District)."""
    out = f.groupBy("State", "District").agg(
        F.sum(REMAIN).alias("unspent_amount"),
        _mean_util().alias("avg_utilization"),
        F.count(F.lit(1)).alias("records"))
    return to_output(out.orderBy("State", "District"))


def context_stats(f: DataFrame) -> DataFrame:
    """One row of totals for an assistant's context (JSON via ``to_records``)."""
    out = f.agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(ALLOC).alias("total_allocated_cr"),
        F.sum(SPENT).alias("total_spent_cr"),
        _mean_util().alias("avg_utilization"),
        F.count(F.when(_sql_anomaly(), 1)).alias("anomaly_count"),
        F.countDistinct("Department").alias("departments"),
    )
    return to_output(out)


def anomaly_tag_kpis(f: DataFrame) -> DataFrame:
    """A13 (exact part): per department, total rows and tagged anomalies with
    the pandas-side test (NULL -> 'Normal', upper-cased, not 'NORMAL')."""
    tagged = F.upper(F.coalesce(F.col(TAG), F.lit(S.NORMAL_TAG))) != F.lit("NORMAL")
    return (f.groupBy("Department").agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count(F.when(tagged, 1)).alias("tagged_anomalies"))
        .orderBy("Department"))


def _quarters(f: DataFrame) -> DataFrame:
    """One row per (State, District, Year, Quarter) with ``at``, the number of
    the quarter on the calendar (NULL where Year or Quarter cannot be read)."""
    g = f.groupBy("State", "District", "Year", "Quarter").agg(
        mean(F.sum("District_Development_Index"),
             F.count("District_Development_Index")).alias("avg_index"),
        _mean_util().alias("avg_utilization"),
        F.count(F.lit(1)).alias("records"))
    q = F.regexp_extract("Quarter", "^Q([1-4])$", 1).try_cast("int")
    return g.withColumn("at", F.col("Year") * 4 + q - 1)


def development_trend(f: DataFrame, after_gap: str = "null") -> DataFrame:
    """Mean development index and utilization per (State, District, Year,
    Quarter), with the change against the previous quarter of that district.
    Where the district has no rows in the previous quarter the change is NULL,
    or with ``after_gap="as_of"`` the one against its last quarter that has.

    The window runs over the grouped result (one row per quarter), never over
    raw facts.
    """
    if after_gap not in ("null", "as_of"):
        raise ValueError("after_gap is 'null' or 'as_of'")
    g = _quarters(f)
    w = Window.partitionBy("State", "District").orderBy("at", "Year", "Quarter")
    follows = F.col("at") - F.lag("at").over(w) == 1 if after_gap == "null" else F.col("at").isNotNull()
    out = g.withColumns({f"{c}_change": F.when(follows, F.col(f"avg_{c}") - F.lag(f"avg_{c}").over(w)) for c in ("utilization", "index")})
    return out.drop("at").orderBy("State", "District", "Year", "Quarter")


def development_axis(f: DataFrame) -> DataFrame:
    """W3 on a dense axis: every quarter from the first to the last one of a
    district, ``records`` 0 where it has none, with the value as of that
    quarter (its own, or the last known one) and how many quarters old it is.
    Rows whose Year or Quarter cannot be read have no place on the axis."""
    g = materialize(_quarters(f).where("at is not null"), "quarters")  # read twice, a row per quarter
    spine = (g.groupBy(F.col("State").alias("s"), F.col("District").alias("d")).agg(F.min("at").alias("a"), F.max("at").alias("b"))
             .select("s", "d", F.explode(F.sequence("a", "b")).alias("place")))
    on = F.col("s").eqNullSafe(F.col("State")) & F.col("d").eqNullSafe(F.col("District")) & (F.col("place") == F.col("at"))
    w = Window.partitionBy("s", "d").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known_at = F.last("at", ignorenulls=True).over(w)
    known = F.last(F.when(F.col("records").isNotNull(), F.struct("avg_index", "avg_utilization")), ignorenulls=True).over(w)
    out = spine.join(g, on, "left").select("s", "d", "place", "records", known_at.alias("known_at"), known.alias("known"))
    return out.select(
        F.col("s").alias("State"), F.col("d").alias("District"), F.floor(F.col("place") / 4).cast("int").alias("Year"),
        F.concat(F.lit("Q"), (F.col("place") % 4 + 1).cast("string")).alias("Quarter"),
        F.coalesce("records", F.lit(0)).cast("bigint").alias("records"), F.col("known.avg_index").alias("index_as_of"),
        F.col("known.avg_utilization").alias("utilization_as_of"), (F.col("place") - F.col("known_at")).cast("int").alias("quarters_old"),
    ).orderBy("State", "District", "Year", "Quarter")
