"""A1 with approximate distincts: HyperLogLog sketches per department and year.

Exact distinct counts of high-cardinality columns (projects, schemes in a
district) shuffle every value for every slice that is asked for. Here facts are
reduced once to one sketch per (Department, Year, column); a slice merges its
sketches, a few kilobytes each, and never reads facts. Sketches of deliveries
merge the same way, so new facts cost one pass over themselves.

The relative standard error is about 1.04 / sqrt(2 ** lg_k), 1.6 % for the
default of 12; small counts (some hundreds) are exact. NULL is not counted, as
in COUNT(DISTINCT).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12
SLICE_KEYS = ["Department", "Year"]
COUNTED = ["Project_ID", "State", "District", "Ministry", "Scheme_Name"]


def relative_error(lg_k: int = LG_K) -> float:
    """The standard error of an estimate, relative to the count."""
    return 1.04 / 2 ** (lg_k / 2)


def distinct_sketches(f: DataFrame, counted: list[str] | None = None, keys: list[str] | None = None, lg_k: int = LG_K) -> DataFrame:
    """One row per ``keys``: a sketch for each counted column (``sk_<column>``).
    Partial sketches are merged map-side, so a hot department sends one sketch
    per task. Write it once, and append the sketches of later deliveries."""
    counted, keys = counted or COUNTED, keys or SLICE_KEYS
    return f.groupBy(*keys).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(f"sk_{c}") for c in counted])


def approximate_distincts(sketches: DataFrame, by: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Estimated distinct counts (``approx_<column>``) of any slice: the sketches
    that ``where`` keeps, merged per ``by`` (one row for all without it). A slice
    without rows has 0."""
    if where is not None:
        sketches = sketches.where(where)
    columns = [c for c in sketches.columns if c.startswith("sk_")]
    merged = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).cast("bigint").alias("approx_" + c[3:]) for c in columns]
    return sketches.groupBy(*by).agg(*merged) if by else sketches.agg(*merged)


def measured_distincts(f: DataFrame, sketches: DataFrame, by: list[str], counted: list[str] | None = None) -> DataFrame:
    """Exact counts beside the estimates: per slice and counted column ``exact``,
    ``approx`` and ``error`` (relative; 0 where both are 0). For checking a choice
    of ``lg_k``: the exact side reads all facts.

    One pass per column reduces facts to distinct (slice, value) pairs; a slice
    that is NULL is a slice."""
    counted = counted or COUNTED
    approx = approximate_distincts(sketches, by)
    stacked = approx.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("counted"), F.col(f"approx_{c}").alias("approx")) for c in counted])).alias("_x")).select(*by, "_x.*")
    exact = None
    for c in counted:
        one = f.groupBy(*by).agg(F.countDistinct(c).alias("exact")).withColumn("counted", F.lit(c))
        exact = one if exact is None else exact.unionByName(one)
    same = [exact[k].eqNullSafe(stacked[k]) for k in [*by, "counted"]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    off = F.abs(F.col("approx") - F.col("exact"))
    return exact.join(stacked, on, "inner").select(
        *[exact[k] for k in by], exact["counted"], "exact", "approx",
        F.when(off == 0, 0.0).otherwise(off / F.greatest("exact", F.lit(1))).alias("error"))
