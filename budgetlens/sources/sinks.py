"""Writing facts and emitting JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetlens.functions.numeric import nan_to_null

# The reference indexes State, District, Ministry, Department, Year and
# Utilization for lookups. On Parquet the same lookups are served by layout:
# directory partitions on Department (partition pruning) and rows sorted by
# State then utilization inside each file (row-group min/max skipping).
PARTITION_COLUMNS = ["Department"]
SORT_COLUMNS = ["State", "Utilization_Percentage"]


def write_facts(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None,
                sort_by: list[str] | None = None, compression: str | None = None) -> str:
    """S4 + S5: replace the stored fact table at ``path``.

    No extra shuffle: each task sorts its own rows by (partition columns, sort
    columns) and writes one file per partition value it holds, one writer open
    at a time. A hot department is spread over all tasks rather than landing
    in one. ``compression`` is the session's unless given.
    """
    partition_by = PARTITION_COLUMNS if partition_by is None else partition_by
    sort_by = SORT_COLUMNS if sort_by is None else sort_by
    (df.sortWithinPartitions(*partition_by, *sort_by)
       .write.mode(mode)
       .partitionBy(*partition_by)
       .parquet(path, compression=compression))
    return path


def to_records(df: DataFrame) -> DataFrame:
    """One JSON object per row, NULL (and NaN, X12) kept as ``null``."""
    return nan_to_null(df).select(F.to_json(F.struct(*df.columns),
                               {"ignoreNullFields": "false"}).alias("record"))


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """S9 at the sink: JSON lines, nulls kept, NaN as null."""
    nan_to_null(df).write.mode(mode).option("ignoreNullFields", "false").json(path)
    return path
