"""D1, D2 distinct value lists; L10 paging counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_values(f: DataFrame, column: str) -> DataFrame:
    """Distinct values of one column, ascending (NULL first, as SQL)."""
    return f.select(column).distinct().orderBy(F.col(column).asc_nulls_first())


def list_districts(f: DataFrame, state: str | None = None) -> DataFrame:
    """Districts of one state; (State, District) pairs when None."""
    if state is not None:
        return list_values(f.filter(F.col("State") == F.lit(state)), "District")
    return (f.select("State", "District").distinct()
            .orderBy(F.col("State").asc_nulls_first(), F.col("District").asc_nulls_first()))


def page(df: DataFrame, n: int, order: list[str | Column]) -> DataFrame:
    """The first ``n`` rows of ``df`` in a total ``order``."""
    return df.orderBy(*order).limit(n)


def page_counts(df: DataFrame, n: int) -> DataFrame:
    """One row with how many rows a page of ``n`` shows and how many more
    exist (the "+N more" / "Showing n of m" labels)."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.least(F.col("total"), F.lit(n).cast("bigint")).alias("shown"),
        F.greatest(F.col("total") - F.lit(n), F.lit(0).cast("bigint")).alias("more"))
