"""The alert stream over fact files (availableNow), restart and replay."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from budgetlens.session import scratch_path
from budgetlens.streaming import alerts as ST
from tests.conftest import make_facts


def _write_files(spark, src, files=3, per_file=10):
    for k in range(files):
        rows = [{"Project_ID": f"F{k}-{i}", "District": f"D{i % 3}",
                 "Utilization_Percentage": Decimal("10.00") if i % 2 == 0 else Decimal("90.00")}
                for i in range(per_file)]
        make_facts(spark, rows).coalesce(1).write.mode("append").parquet(src)


def test_available_now_alerts_per_batch_and_restart(spark):
    src, sink, ckpt = (scratch_path(spark, n) for n in ("src", "sink", "ckpt"))
    _write_files(spark, src)
    q = ST.alert_stream(ST.read_fact_stream(spark, src, 1), sink, ckpt, available_now=True)
    q.awaitTermination()
    alerts = ST.read_alerts(spark, sink)
    per_batch = {r["batch_id"]: r["n"] for r in
                 alerts.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(per_batch) == 3 and all(n == 3 for n in per_batch.values())
    row = alerts.first()
    assert row["type"] == "critical_underspend" and row["severity"] == "high"
    assert row["title"].startswith("Critical Underspend: D")
    assert "allocated ₹100.0Cr but spent only ₹50.0Cr" in row["message"]
    # restart from the checkpoint with no new files: nothing added
    q2 = ST.alert_stream(ST.read_fact_stream(spark, src), sink, ckpt, available_now=True)
    q2.awaitTermination()
    assert ST.read_alerts(spark, sink).count() == 9


def test_replayed_batch_overwrites_its_partition(spark):
    sink = scratch_path(spark, "sink")
    cands = ST.alert_candidates(make_facts(spark, [
        {"Project_ID": f"P{i}", "Utilization_Percentage": Decimal("5.00")} for i in range(6)]))
    for _ in range(2):  # the same batch id delivered twice
        (ST.pick_alerts(cands, 7).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(sink))
    got = ST.read_alerts(spark, sink)
    assert got.count() == 3
    first = {r["Project_ID"] for r in got.collect()}
    again = {r["Project_ID"] for r in ST.pick_alerts(cands, 7).collect()}
    assert first == again                       # repeatable pick for a batch id


def test_alert_view_and_unread(spark):
    rows = spark.createDataFrame([
        ("a1", "high", "2024-01-02 00:00:00", None),
        ("a2", "low", "2024-01-03 00:00:00", True),
        ("a3", "medium", "2024-01-03 00:00:00", False),
    ], "alert_id string, severity string, ts string, read boolean") \
        .withColumn("timestamp", F.to_timestamp("ts"))
    view = [r["alert_id"] for r in ST.alert_view(rows, 2).collect()]
    assert view == ["a3", "a2"]                  # newest, then higher severity
    u = ST.alert_unread(rows).first()
    assert u["unread"] == 2 and u["alerts"] == 3


def test_watermark_drops_repeat_alerts(spark):
    src, sink, ckpt = (scratch_path(spark, n) for n in ("src", "sink", "ckpt"))
    for k in range(2):  # the same projects arrive in two files
        rows = [{"Project_ID": f"P{i}", "Utilization_Percentage": Decimal("10.00")}
                for i in range(2)]
        make_facts(spark, rows).withColumn(
            "ingested_at", F.to_timestamp(F.lit(f"2024-01-0{k + 1} 00:00:00"))) \
            .coalesce(1).write.mode("append").parquet(src)
    from pyspark.sql import types as T

    from budgetlens.schema import FACT_SCHEMA
    schema = T.StructType(FACT_SCHEMA.fields + [T.StructField("ingested_at", T.TimestampType())])
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    q = ST.alert_stream(stream, sink, ckpt, available_now=True, event_time="ingested_at",
                        dedup_delay="7 days")
    q.awaitTermination()
    got = ST.read_alerts(spark, sink)
    assert got.count() == 2                     # second file repeats both projects
    assert got.select("Project_ID").distinct().count() == 2


def test_project_that_drops_later_alerts_and_empty_sink(spark):
    from pyspark.sql import types as T

    from budgetlens.schema import FACT_SCHEMA
    src, sink, ckpt = (scratch_path(spark, n) for n in ("src", "sink", "ckpt"))
    assert ST.read_alerts(spark, sink).count() == 0 and ST.alert_unread(ST.read_alerts(spark, sink)).first()["unread"] == 0
    schema = T.StructType(FACT_SCHEMA.fields + [T.StructField("ingested_at", T.TimestampType())])
    for day, used in ((1, "90.00"), (2, "10.00")):
        make_facts(spark, [{"Project_ID": "P", "Utilization_Percentage": Decimal(used)}]).withColumn(
            "ingested_at", F.to_timestamp(F.lit(f"2024-01-0{day} 00:00:00"))).coalesce(1).write.mode("append").parquet(src)
        ST.alert_stream(spark.readStream.schema(schema).parquet(src), sink, ckpt, available_now=True, event_time="ingested_at").awaitTermination()
    assert ST.read_alerts(spark, sink).count() == 1


def test_unread_counts_the_newest_only(spark):
    rows = spark.range(80).selectExpr("cast(id as string) AS alert_id", "'high' AS severity", "timestamp_seconds(id) AS timestamp", "id >= 75 AS read")
    u = ST.alert_unread(rows).first()
    assert (u["unread"], u["alerts"]) == (45, 50)
