"""Fund-reallocation suggestions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from budgetlens import schema as S
from budgetlens.functions.text import fixed1, location
from budgetlens.operators.aggregates import SCHEME_KEYS, scheme_groups

# The reference's reallocation shares.
SURPLUS_SHARE = Decimal("0.7")
DEFICIT_SHARE = Decimal("0.5")
FALLBACK_SURPLUS_SHARE = Decimal("0.3")


def _amount(surplus: Column, deficit: Column) -> Column:
    """min(0.7 * surplus, 0.5 * deficit if deficit > 0 else 0.3 * surplus), 2 dp."""
    other = F.when(deficit > 0, deficit * F.lit(DEFICIT_SHARE)) \
             .otherwise(surplus * F.lit(FALLBACK_SURPLUS_SHARE))
    return F.round(F.least(surplus * F.lit(SURPLUS_SHARE), other), 2).cast("double")


def _reason(u_util: Column, o_util: Column) -> Column:
    return F.concat(F.lit("Reallocate from underutilized ("), fixed1(u_util),
                    F.lit("%) to overburdened ("), fixed1(o_util), F.lit("%) scheme"))


def _ranked(groups: DataFrame, under_threshold: float, over_threshold: float,
            partition: list[str], n: int) -> DataFrame:
    """Both candidate lists from one pass over the grouped rows: each group is
    'under' or 'over' (never both), ranked inside (partition, side) by surplus
    or deficit, top ``n`` kept. ``row_number() <= n`` plans as a
    ``WindowGroupLimit`` before the shuffle, so only ``n`` rows per side (and
    partition key) per map task move."""
    side = (F.when(F.col("utilization") < F.lit(float(under_threshold)), F.lit("under"))
            .when(F.col("utilization") > F.lit(float(over_threshold)), F.lit("over")))
    key = F.when(F.col("side") == "under", F.col("surplus")).otherwise(F.col("deficit"))
    others = [k for k in SCHEME_KEYS if k not in partition]
    w = Window.partitionBy(*partition, "side").orderBy(F.col("_key").desc_nulls_last(), *others)
    return (groups.withColumn("side", side).filter(F.col("side").isNotNull())
            .withColumn("_key", key)
            .withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= n))


def _pairs(ranked: DataFrame, partition: list[str]) -> DataFrame:
    """Zip the two lists on rank (within ``partition``): one group-by on the
    rank, one struct per side; ranks missing on either side drop out."""
    fields = ["State", "District", "Department", "Scheme_Name", "utilization",
              "surplus", "deficit"]
    pick = {s: F.max(F.when(F.col("side") == s, F.struct(*fields))).alias(s)
            for s in ("under", "over")}
    return (ranked.groupBy(*partition, "rank").agg(pick["under"], pick["over"])
            .filter(F.col("under").isNotNull() & F.col("over").isNotNull()))


def reallocate(f: DataFrame, under_threshold: float = S.UNDER_UTILIZATION,
               over_threshold: float = S.OVER_UTILIZATION,
               n: int = S.REALLOCATION_CANDIDATES) -> DataFrame:
    """The reference's pairing: rank i of the top-``n`` under-utilised list
    with rank i of the top-``n`` over-utilised list, kept only when both are
    the same Department (J1). One aggregation, one ranking, no join."""
    pairs = _pairs(_ranked(scheme_groups(f), under_threshold, over_threshold, [], n), [])
    u, o = F.col("under"), F.col("over")
    return pairs.filter(u["Department"] == o["Department"]).select(
        F.col("rank").cast("int").alias("rank"),
        location(u["District"], u["State"]).alias("from_location"),
        location(o["District"], o["State"]).alias("to_location"),
        u["Department"].alias("department"),
        u["Scheme_Name"].alias("scheme"),
        F.concat(fixed1(u["utilization"]), F.lit("%")).alias("current_utilization_from"),
        F.concat(fixed1(o["utilization"]), F.lit("%")).alias("current_utilization_to"),
        _amount(u["surplus"], o["deficit"]).alias("suggested_amount_cr"),
        _reason(u["utilization"], o["utilization"]).alias("reason"),
    ).orderBy("rank")


def reallocate_within_department(f: DataFrame, k: int = S.REALLOCATION_CANDIDATES,
                                 under_threshold: float = S.UNDER_UTILIZATION,
                                 over_threshold: float = S.OVER_UTILIZATION) -> DataFrame:
    """Rank under- and over-utilised schemes inside each Department and
    pair equal ranks, so no pair is lost to a rank mismatch across
    departments."""
    ranked = _ranked(scheme_groups(f), under_threshold, over_threshold, ["Department"], k)
    u, o = F.col("under"), F.col("over")
    return _pairs(ranked, ["Department"]).select(
        "Department", F.col("rank").cast("int").alias("rank"),
        u["District"].alias("from_district"), u["State"].alias("from_state"),
        o["District"].alias("to_district"), o["State"].alias("to_state"),
        u["Scheme_Name"].alias("from_scheme"), o["Scheme_Name"].alias("to_scheme"),
        u["utilization"].alias("from_utilization"),
        o["utilization"].alias("to_utilization"),
        _amount(u["surplus"], o["deficit"]).alias("suggested_amount"),
        _reason(u["utilization"], o["utilization"]).alias("reason"),
    ).orderBy("Department", "rank")
