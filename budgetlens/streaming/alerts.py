"""Underspend alerts as a Structured Streaming job, and their views.

The reference polls its table every 30 seconds, picks three random rows under
30% utilization and pushes an alert for each. Here the facts arrive as files;
each micro-batch keeps the rows under the threshold, picks ``n`` of them in a
repeatable hash order, and writes them keyed by batch id, so a replayed
batch overwrites its own output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from budgetlens import schema as S
from budgetlens.functions.bands import severity_rank
from budgetlens.functions.text import fixed1, text_or_none

ALERT_TYPE = "critical_underspend"
ALERT_SEVERITY = "high"


def _message() -> Column:
    """"{Department} in {District}, {State} — allocated ₹{a:.1f}Cr but spent
    only ₹{s:.1f}Cr" (NULL parts print as 'None', as Python does)."""
    return F.concat(
        text_or_none("Department"), F.lit(" in "), text_or_none("District"), F.lit(", "),
        text_or_none("State"), F.lit(" — allocated ₹"),
        F.coalesce(fixed1("Allocated_Budget_Cr"), F.lit("None")),
        F.lit("Cr but spent only ₹"),
        F.coalesce(fixed1("Actual_Spending_Cr"), F.lit("None")), F.lit("Cr"))


def alert_candidates(f: DataFrame, threshold: float = S.ALERT_THRESHOLD,
                     keep: list[str] | None = None) -> DataFrame:
    """Every row under the utilization threshold, as an alert without
    time (``keep`` carries extra fact columns). Works on a batch or a
    streaming DataFrame."""
    return (f.filter(F.col("Utilization_Percentage") < F.lit(threshold))
            .select("Project_ID", *(keep or []),
                    F.lit(ALERT_TYPE).alias("type"),
                    F.lit(ALERT_SEVERITY).alias("severity"),
                    F.concat(F.lit("Critical Underspend: "), text_or_none("District"))
                    .alias("title"),
                    _message().alias("message")))


def pick_alerts(candidates: DataFrame, batch_id: int, n: int = S.ALERT_ROWS,
                seed: int = S.FOREST_SEED) -> DataFrame:
    """``n`` candidates in a repeatable pseudo-random order for this batch
    (md5 of seed, batch id and Project_ID), stamped with the batch id and the
    current time (X8)."""
    order = F.md5(F.concat(F.lit(f"{seed}-{batch_id}-"), F.col("Project_ID")))
    return (candidates.orderBy(order, "Project_ID").limit(n)
            .withColumn("timestamp", F.current_timestamp())
            .withColumn("batch_id", F.lit(batch_id).cast("long"))
            .withColumn("alert_id", F.concat(F.lit(f"{batch_id}-"), F.col("Project_ID"))))


def read_fact_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Facts arriving as Parquet files in ``path``; ``files_per_trigger``
    limits a micro-batch (no limit by default)."""
    reader = spark.readStream.schema(S.FACT_SCHEMA)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def alert_stream(stream: DataFrame, sink_path: str, checkpoint_path: str,
                 threshold: float = S.ALERT_THRESHOLD, n: int = S.ALERT_ROWS,
                 seed: int = S.FOREST_SEED, trigger_seconds: int = 30,
                 available_now: bool = False, event_time: str | None = None,
                 dedup_delay: str = "1 day") -> StreamingQuery:
    """Start the alert job. Each micro-batch writes its alerts to
    ``sink_path/batch_id=N`` with dynamic partition overwrite (idempotent on
    replay). With ``event_time`` a watermark on that column drops repeat
    alerts for the same Project_ID (``dropDuplicatesWithinWatermark``)."""
    if event_time is not None:
        # the filter comes first: state holds alerts only, and a project that
        # was fine when first seen still alerts when it drops
        stream = stream.filter(F.col("Utilization_Percentage") < F.lit(threshold))
        stream = (stream.withWatermark(event_time, dedup_delay)
                  .dropDuplicatesWithinWatermark(["Project_ID"]))
    candidates = alert_candidates(stream, threshold)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (pick_alerts(batch, batch_id, n, seed).write
         .mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(sink_path))

    writer = (candidates.writeStream.foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint_path))
    if available_now:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start()


ALERT_SCHEMA = ("Project_ID string, type string, severity string, title string, message string, "
                "timestamp timestamp, alert_id string, batch_id long")


def read_alerts(spark: SparkSession, sink_path: str) -> DataFrame:
    """The alerts written so far; none where nothing was written yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink_path)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ALERT_SCHEMA)
    return spark.read.schema(ALERT_SCHEMA).parquet(sink_path)


def alert_view(alerts: DataFrame, n: int = S.ALERT_VIEW_ROWS) -> DataFrame:
    """The newest ``n`` alerts (then highest severity, then alert id)."""
    return (alerts.orderBy(F.col("timestamp").desc_nulls_last(),
                           severity_rank("severity").desc(), F.col("alert_id"))
            .limit(n))


def alert_unread(alerts: DataFrame, n: int = S.ALERT_VIEW_ROWS) -> DataFrame:
    """Alerts not marked read (a missing ``read`` flag means unread) among
    the newest ``n``, which are what a client holds."""
    alerts = alert_view(alerts, n)
    read = F.col("read") if "read" in alerts.columns else F.lit(None).cast("boolean")
    return alerts.agg(F.count(F.when(~F.coalesce(read, F.lit(False)), 1))
                      .alias("unread"), F.count(F.lit(1)).alias("alerts"))
