"""A1, A2, A6, A16 kept up to date: partial states per delivery.

Each delivery of facts is reduced once to a partial state: per (State, District,
Ministry, Department) the sums and counts that the reports are made of, all
exact (decimal sums, row counts), so states can be added in any order. The
number of rows of a value is part of it, which makes distinct counts exact: a
value is there as long as a delivery has rows of it. The states lie in one
folder, one partition per delivery. A delivery that comes again replaces its
partition, which takes back all it had said before; a removed one likewise.

A report adds up the states, a few rows per delivery, and never reads facts: a
refresh costs one pass over the new delivery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from budgetlens import schema as S
from budgetlens.functions.numeric import bigint, mean, to_output
from budgetlens.operators.aggregates import ALLOC, DELAY, REMAIN, SPENT, UTIL, _sql_anomaly
from budgetlens.session import materialize

KEYS = ["State", "District", "Ministry", "Department"]
_MONEY = "decimal(38,4)"
#: Columns of a state beside its keys.
STATE = f"""rows bigint, allocated {_MONEY}, spent {_MONEY}, remaining {_MONEY}, util_sum {_MONEY}, util_rows bigint,
delay_sum bigint, delay_rows bigint, allocated_rows bigint, spent_rows bigint, remaining_rows bigint, under bigint, over bigint, anomalies bigint"""
STATE_SCHEMA = ", ".join(f"{k} string" for k in KEYS) + f", {STATE}, delivery string"


def partial_state(f: DataFrame, under: float = S.CRITICAL_UNDERSPEND, over: float = S.CRITICAL_OVERSPEND) -> DataFrame:
    """The state of one delivery. Sums are 0 where all values are NULL; the
    counts of values tell."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(_MONEY)
    return f.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("rows"), total(ALLOC).alias("allocated"), total(SPENT).alias("spent"), total(REMAIN).alias("remaining"),
        total(UTIL).alias("util_sum"), F.count(UTIL).alias("util_rows"), F.coalesce(F.sum(DELAY), F.lit(0)).cast("bigint").alias("delay_sum"),
        F.count(DELAY).alias("delay_rows"), F.count(ALLOC).alias("allocated_rows"), F.count(SPENT).alias("spent_rows"), F.count(REMAIN).alias("remaining_rows"),
        F.count(F.when(F.col(UTIL) < under, 1)).alias("under"), F.count(F.when(F.col(UTIL) > over, 1)).alias("over"),
        F.count(F.when(_sql_anomaly(), 1)).alias("anomalies"))


def apply_delivery(f: DataFrame, path: str, delivery: str) -> None:
    """Put the state of delivery ``delivery`` in place, instead of the one it
    had. An empty delivery leaves no rows: use it to take a delivery back."""
    rows = materialize(partial_state(f).withColumn("delivery", F.lit(delivery)), "delivery")
    if rows.isEmpty():
        remove_delivery(f.sparkSession, path, delivery)
        return
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("delivery").parquet(path)


def remove_delivery(spark: SparkSession, path: str, delivery: str) -> None:
    """Take back all that ``delivery`` had said."""
    jvm = spark.sparkContext._jvm
    escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(delivery)
    name = jvm.org.apache.hadoop.fs.Path(f"{path}/delivery={escaped}")
    name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(name, True)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """States of all deliveries (none yet: no rows)."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(name):
        return spark.createDataFrame([], STATE_SCHEMA)
    return spark.read.schema(STATE_SCHEMA).parquet(path)


def _total(c: str):
    """The sum that a report shows: NULL where no row has a value."""
    return F.when(F.sum(f"{c}_rows") > 0, F.sum(c))


def _mean_util():
    return mean(F.sum("util_sum"), F.sum("util_rows"))


def _mean_delay():
    return mean(F.sum("delay_sum"), F.sum("delay_rows"))


def summary(state: DataFrame) -> DataFrame:
    """A1 from states: a value counts as distinct while a delivery has rows of it."""
    groups = state.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in (
        "rows", "allocated", "spent", "util_sum", "util_rows", "allocated_rows", "spent_rows", "under", "over")])
    out = groups.agg(
        *[F.countDistinct(k).alias(f"total_{n}") for k, n in zip(KEYS, ("states", "districts", "ministries", "departments"))],
        _total("allocated").alias("total_allocated_cr"), _total("spent").alias("total_spent_cr"), _mean_util().alias("avg_utilization"),
        bigint(F.sum("under")).alias("critical_underspend"), bigint(F.sum("over")).alias("critical_overspend"))
    return to_output(out.withColumn("total_waste_cr", F.col("total_allocated_cr") - F.col("total_spent_cr")))


def department_summary(state: DataFrame, department: str | None = None) -> DataFrame:
    """A2 from states, of one department or of all."""
    keys = ["State", "District"]
    if department is not None:
        state = state.where(F.col("Department") == F.lit(department))
    else:
        keys = ["Department", *keys]
    out = state.groupBy(*keys).agg(
        _total("allocated").alias("total_allocated"), _total("spent").alias("total_spent"), _mean_util().alias("avg_utilization"),
        _total("remaining").alias("total_remaining"), _mean_delay().alias("avg_delay"), bigint(F.sum("anomalies")).alias("anomaly_count"))
    return to_output(out.orderBy(F.col("avg_utilization").asc_nulls_first(), *keys))


def state_summary(state: DataFrame, of: str | None = None) -> DataFrame:
    """A6 from states, of one State or of all."""
    keys = ["District", "Department"]
    if of is not None:
        state = state.where(F.col("State") == F.lit(of))
    else:
        keys = ["State", *keys]
    out = state.groupBy(*keys).agg(_total("allocated").alias("allocated"), _total("spent").alias("spent"),
                                   _mean_util().alias("utilization"), _mean_delay().alias("avg_delay"))
    return to_output(out.orderBy(F.col("utilization").asc_nulls_first(), *keys))


def context_stats(state: DataFrame) -> DataFrame:
    """A16 from states."""
    return to_output(state.agg(
        bigint(F.coalesce(F.sum("rows"), F.lit(0))).alias("records"), _total("allocated").alias("total_allocated_cr"), _total("spent").alias("total_spent_cr"),
        _mean_util().alias("avg_utilization"), bigint(F.coalesce(F.sum("anomalies"), F.lit(0))).alias("anomaly_count"),
        F.countDistinct("Department").alias("departments")))
