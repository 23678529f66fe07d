"""Alerts with memory: fall, recovery, second fall, expiry, replay, feed."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.session import scratch_path
from budgetlens.streaming import lifecycle as LC

SCHEMA = "project string, at timestamp, utilization decimal(9,2)"
KEYS = [T.StructField("project", T.StringType())]


def _day(n):
    return datetime(2024, 1, 1) + timedelta(days=n)


def _deliver(spark, src, rows):
    frame = spark.createDataFrame([(p, None if d is None else _day(d).isoformat(" "), u) for p, d, u in rows],
                                  "project string, at string, utilization double")
    (frame.select("project", F.to_timestamp("at").alias("at"), F.col("utilization").cast("decimal(9,2)").alias("utilization"))
     .coalesce(1).write.mode("append").parquet(src))


def _run(spark, src, sink, ckpt, **rules):
    stream = spark.readStream.schema(SCHEMA).parquet(src)
    LC.start_lifecycle(stream, ["project"], sink, ckpt, available_now=True, **rules).awaitTermination()


def _events(spark, sink):
    day = lambda c: F.datediff(c, F.lit("2024-01-01"))
    rows = LC.read_events(spark, sink, KEYS).select("project", "kind", day("at").alias("at"), day("since").alias("since"))
    return sorted((r["project"] or "", r["at"], r["kind"], r["since"]) for r in rows.collect())


def test_fall_recovery_second_fall_expiry_and_replay(spark):
    src, sink, ckpt = (scratch_path(spark, n) for n in ("readings", "alerts", "ckpt"))
    rules = {"threshold": 30, "recovered": 40, "expire": timedelta(days=50)}
    _deliver(spark, src, [("a", 0, 10.0), ("a", 5, 35.0), ("a", 6, 20.0), ("b", 0, 90.0), (None, 1, 5.0),
                          ("c", None, 1.0), ("c", 2, None), ("d", 0, 29.99), ("d", 0, 80.0)])
    _run(spark, src, sink, ckpt, **rules)
    # one alert each; 35 lies between the bounds; two readings of a moment count as the lowest
    assert _events(spark, sink) == [("", 1, "opened", 1), ("a", 0, "opened", 0), ("d", 0, "opened", 0)]
    _deliver(spark, src, [("a", 10, 40.0), ("a", 20, 12.0), ("b", 20, 30.0), ("d", 20, 15.0)])
    _run(spark, src, sink, ckpt, **rules)
    second = [("", 1, "opened", 1), ("a", 0, "opened", 0), ("a", 10, "recovered", 0), ("a", 20, "opened", 20), ("d", 0, "opened", 0)]
    assert _events(spark, sink) == second
    _run(spark, src, sink, ckpt, **rules)  # nothing new: nothing added
    assert _events(spark, sink) == second
    # time moves on: the NULL key (timer) and a (found by its next reading) expire; late readings change nothing
    _deliver(spark, src, [("a", 75, 10.0), ("b", 75, 99.0), ("d", 60, 10.0), ("d", 59, 99.0)])
    _run(spark, src, sink, ckpt, **rules)
    _deliver(spark, src, [("b", 15, 1.0)])  # older than the watermark
    _run(spark, src, sink, ckpt, **rules)
    got = _events(spark, sink)
    assert got == sorted(second + [("", 51, "expired", 1), ("a", 70, "expired", 20), ("a", 75, "opened", 75),
                                   ("d", 59, "recovered", 0), ("d", 60, "opened", 60)])


def test_batches_do_not_change_events(spark):
    rows = [(f"p{i % 5}", d, float((i * 37 + d * 53) % 60)) for i in range(5) for d in range(0, 120, 1 + 7 * (i + 1))]
    rows.append(("clock", 400, 99.0))
    got = []
    for parts in (1, 4):
        src, sink, ckpt = (scratch_path(spark, n) for n in ("readings", "alerts", "ckpt"))
        ordered = sorted(rows, key=lambda r: r[1])
        size = -(-len(ordered) // parts)
        for i in range(0, len(ordered), size):
            _deliver(spark, src, ordered[i:i + size])
            _run(spark, src, sink, ckpt, threshold=20, expire=timedelta(days=30), delay="1 second")
        got.append(_events(spark, sink))
    assert got[0] == got[1] and {k for _, _, k, _ in got[0]} == {"opened", "recovered", "expired"}


def test_feed_keeps_newest_and_marks(spark):
    src, sink, ckpt = (scratch_path(spark, n) for n in ("readings", "alerts", "ckpt"))
    assert LC.read_feed(spark, sink, KEYS).count() == 0 and LC.read_events(spark, sink, KEYS).count() == 0
    _deliver(spark, src, [(f"p{i}", i, 1.0) for i in range(4)])
    _run(spark, src, sink, ckpt, n=3)
    feed = {r["project"]: r for r in LC.read_feed(spark, sink, KEYS).collect()}
    assert set(feed) == {"p1", "p2", "p3"} and not any(r["read"] for r in feed.values())
    LC.mark_read(spark, sink, [feed["p3"]["alert_id"]])
    LC.mark_read(spark, sink, [feed["p3"]["alert_id"]])
    _deliver(spark, src, [("p9", 9, 1.0)])
    _run(spark, src, sink, ckpt, n=3)
    assert {r["project"]: r["read"] for r in LC.read_feed(spark, sink, KEYS).collect()} == {"p2": False, "p3": True, "p9": False}


def test_recovery_bound_is_not_under_threshold(spark):
    with pytest.raises(ValueError):
        LC.alert_events(spark.readStream.format("rate").load(), ["value"], at="timestamp", utilization="value",
                        threshold=30, recovered=20)
