"""Numeric helpers shared by the reports.

Money and percentages stay decimal while summed (exact, independent of
partition order) and become double only on output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def mean(sum_col: Column, count_col: Column) -> Column:
    """Row mean from an exact sum and a non-null count; NULL when count is 0."""
    return F.try_divide(sum_col.cast("double"), count_col.cast("double"))


def bigint(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")


def finite(col: str) -> Column:
    """The column with NaN and infinities as NULL."""
    c = F.col(f"`{col}`")
    return F.when(F.abs(c) < float("inf"), c).alias(col)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of double and float columns become NULL."""
    odd = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[finite(c) if c in odd else F.col(f"`{c}`") for c in df.columns]) if odd else df


def to_output(df: DataFrame) -> DataFrame:
    """The result types every report returns: decimals as doubles, and no NaN
    or infinity (X12: NULL instead)."""
    cols = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.DecimalType):
            cols.append(F.col(field.name).cast("double").alias(field.name))
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            cols.append(finite(field.name))
        else:
            cols.append(F.col(field.name))
    return df.select(*cols)
