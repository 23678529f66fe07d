"""T1/T2 as keyed state: alerts that open, recover, open again and expire.

The stream holds readings: a key (a project, a scheme in a district), a time and
a utilization. Per key the state is whether an alert is open, since when, and
the time of the last reading:

* a reading under ``threshold`` opens an alert where none is open;
* a reading of ``recovered`` or more closes it ("recovered") and arms the key again;
  between the two bounds nothing changes;
* a key without a reading for ``expire`` loses its state; an open alert then ends as
  "expired". An event-time timer does this, so state holds only keys with readings
  in the last ``expire`` before the watermark.

Results do not depend on how readings fall into batches, as long as they come in
the order of time (by key): several readings of one key at one moment count as
their lowest, a reading older than the last one of its key is ignored, and one that is
older than the watermark (the newest time less ``delay``) is dropped by Spark.
Readings without time or utilization are ignored; NULL is a key like any other.

What a task holds at once is one number per moment of one key in one batch.

Each batch writes its events to ``<sink>/events/batch_id=N`` and the newest alerts,
with their read flags, to ``<sink>/feed/batch_id=N``, made from the last batch's feed:
a replayed batch writes the same again.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from budgetlens import schema as S
from budgetlens.session import ship_package
from budgetlens.streaming.alerts import alert_view

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
EVENT_COLUMNS = "kind string, at timestamp, since timestamp, utilization double"


class AlertLifecycle(StatefulProcessor):
    """The state machine of one key; times are milliseconds."""

    def __init__(self, keys: list[str], threshold: float, recovered: float, expire_ms: int) -> None:
        self.keys, self.threshold, self.recovered, self.expire = keys, threshold, recovered, expire_ms

    def init(self, handle) -> None:
        self.handle = handle
        # last reading, start of the open alert (none: NULL)
        self.state = handle.getValueState("alert", "last bigint, since bigint")

    def _event(self, key: tuple, kind: str, at: int, since: int, utilization: float | None) -> Row:
        moment = lambda ms: _EPOCH + timedelta(milliseconds=ms)
        return Row(*self.keys, "kind", "at", "since", "utilization")(
            *key, kind, moment(at), moment(since), utilization)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        lowest: dict[int, float] = {}
        for r in rows:
            at, u = r["_at"], r["_utilization"]
            if at not in lowest or u < lowest[at]:
                lowest[at] = u
        before, since = self.state.get() if self.state.exists() else (None, None)
        last = before
        for at in sorted(lowest):
            if last is not None and at <= last:
                continue
            if last is not None and at >= last + self.expire:
                if since is not None:
                    yield self._event(key, "expired", last + self.expire, since, None)
                since = None
            last, u = at, lowest[at]
            if since is None and u < self.threshold:
                since = at
                yield self._event(key, "opened", at, since, u)
            elif since is not None and u >= self.recovered:
                yield self._event(key, "recovered", at, since, u)
                since = None
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.expire)
            self.handle.registerTimer(last + self.expire)
            self.state.update((last, since))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            last, since = self.state.get()
            self.state.clear()
            if since is not None:
                yield self._event(key, "expired", last + self.expire, since, None)

    def close(self) -> None:
        pass


def alert_events(readings: DataFrame, keys: list[str], at: str = "at", utilization: str = "utilization",
                 threshold: float = S.ALERT_THRESHOLD, recovered: float | None = None,
                 expire: timedelta = timedelta(days=150), delay: str = "1 day") -> DataFrame:
    """The events of a stream of readings: ``keys``, kind (opened, recovered,
    expired), at, since (start of that alert) and the utilization that made it
    (NULL where expired). ``recovered`` is ``threshold`` unless given."""
    recovered = threshold if recovered is None else recovered
    if recovered < threshold:
        raise ValueError("an alert cannot recover under its threshold")
    ship_package(readings.sparkSession)
    types = {f.name: f.dataType for f in readings.schema.fields}
    out = T.StructType([T.StructField(k, types[k]) for k in keys] + T._parse_datatype_string(EVENT_COLUMNS).fields)
    rows = (readings.where(F.col(at).isNotNull() & F.col(utilization).isNotNull()).withWatermark(at, delay)
            .select(*keys, at, F.unix_millis(at).alias("_at"), F.col(utilization).cast("double").alias("_utilization")))
    machine = AlertLifecycle(keys, float(threshold), float(recovered), int(expire.total_seconds() * 1000))
    return rows.groupBy(*keys).transformWithState(machine, out, "Append", "EventTime")


def _exists(spark: SparkSession, path: str) -> bool:
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(name)


def _delete(spark: SparkSession, path: str) -> None:
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(name, True)


def _read_marks(spark: SparkSession, sink: str) -> DataFrame:
    if not _exists(spark, f"{sink}/reads"):
        return spark.createDataFrame([], "alert_id string")
    return spark.read.schema("alert_id string").parquet(f"{sink}/reads")


def mark_read(spark: SparkSession, sink: str, alert_ids: list[str]) -> None:
    """Mark alerts as read, from now on and in the feeds to come."""
    spark.createDataFrame([(a,) for a in alert_ids], "alert_id string").coalesce(1).write.mode("append").parquet(f"{sink}/reads")


def _with_marks(spark: SparkSession, feed: DataFrame, sink: str) -> DataFrame:
    marks = _read_marks(spark, sink).distinct().withColumn("_marked", F.lit(True))
    return (feed.join(marks, "alert_id", "left").select(
        *[c for c in feed.columns if c != "read"], F.coalesce(F.col("read") | F.col("_marked"), "_marked", "read", F.lit(False)).alias("read")))


def start_lifecycle(readings: DataFrame, keys: list[str], sink: str, checkpoint: str, n: int = S.ALERT_VIEW_ROWS,
                    trigger_seconds: int = 30, available_now: bool = False, **rules) -> StreamingQuery:
    """Start the job: ``alert_events`` with ``rules`` over ``readings``, events and
    feed (the newest ``n`` opened alerts) written per batch. The state store is
    RocksDB, on the executors' disks, with its checkpoints in ``checkpoint``."""
    spark = readings.sparkSession
    events = alert_events(readings, keys, **rules)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        mine, before = f"{sink}/events/batch_id={batch_id}", f"{sink}/feed/batch_id={batch_id - 1}"
        batch.write.mode("overwrite").parquet(mine)
        alerts = session.read.schema(batch.schema).parquet(mine).where("kind = 'opened'").select(
            F.sha2(F.to_json(F.struct(*keys, "since"), {"ignoreNullFields": "false"}), 256).alias("alert_id"),
            *keys, F.lit("high").alias("severity"), F.col("at").alias("timestamp"), "utilization", F.lit(False).alias("read"))
        if _exists(session, before):
            alerts = alerts.unionByName(session.read.schema(alerts.schema).parquet(before))
        feed = _with_marks(session, alert_view(alerts, n), sink)
        feed.coalesce(1).write.mode("overwrite").parquet(f"{sink}/feed/batch_id={batch_id}")
        _delete(session, f"{sink}/feed/batch_id={batch_id - 2}")  # a replay needs the last one only

    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)  # the query keeps the settings it was started with
    try:
        writer = events.writeStream.outputMode("append").foreachBatch(write_batch).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{trigger_seconds} seconds")
        return writer.start()
    finally:
        if old is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, old)


def read_events(spark: SparkSession, sink: str, keys: list[T.StructField]) -> DataFrame:
    """All events so far, with their batch."""
    schema = T.StructType(list(keys) + T._parse_datatype_string(EVENT_COLUMNS + ", batch_id bigint").fields)
    if not _exists(spark, f"{sink}/events"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{sink}/events")


def read_feed(spark: SparkSession, sink: str, keys: list[T.StructField]) -> DataFrame:
    """The newest alerts with the marks set until now (none yet: no rows)."""
    schema = T.StructType([T.StructField("alert_id", T.StringType()), *keys] + T._parse_datatype_string(
        "severity string, timestamp timestamp, utilization double, read boolean, batch_id bigint").fields)
    if not _exists(spark, f"{sink}/feed"):
        return spark.createDataFrame([], schema).drop("batch_id")
    feeds = spark.read.schema(schema).parquet(f"{sink}/feed")
    newest = feeds.agg(F.max("batch_id")).first()[0]
    feed = feeds.where(F.col("batch_id") == newest).drop("batch_id") if newest is not None else feeds.drop("batch_id")
    return _with_marks(spark, feed, sink)
