"""Streaming forms: hot placements, event de-duplication, counters, admission.

Event time must be a TIMESTAMP (the trace's is without zone: cast first).
Window results are emitted when the watermark passes them, so the last windows
of a finite stream stay open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A file stream of events with event time ``at``."""
    s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return s.withColumn("at", F.col("ts").cast("timestamp")).withColumn("doc_id", F.get_json_object("props", "$.k").cast("long"))


def hot_stream(events: DataFrame, window: str, late: str, threshold: int) -> DataFrame:
    """Keys read at least ``threshold`` times in an aligned window."""
    w = events.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "doc_id").agg(F.count(F.lit(1)).alias("reads"))
    return w.filter(F.col("reads") >= threshold).select("w.start", "doc_id", "reads")


def dedup_stream(events: DataFrame, late: str) -> DataFrame:
    """At-least-once deliveries: an id seen within the watermark is dropped."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def invalidations(events: DataFrame, sink, checkpoint: str):
    """Latest change per key and batch, handed to ``sink(df, epoch)`` (an upsert)."""

    def batch(df: DataFrame, epoch: int) -> None:
        sink(df.groupBy("doc_id").agg(F.max_by("event_id", F.struct("at", "event_id")).alias("event_id"), F.max("at").alias("at")), epoch)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lease_stream(reads: DataFrame, window_ms: int, threshold: int, lease_ms: int) -> DataFrame:
    """Leases with windows that start at a key's first read, kept in state:
    (window start, count, lease end). State of a key ends with its lease or
    window, by event-time timeout."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count, until = state.get if state.exists else (-1, 0, -1)
        out = []
        for t in sorted(t for f in frames for t in f["ts_ms"].tolist()):
            if until > t:
                continue
            if start < 0 or start + window_ms <= t:
                start, count = t, 0
            count += 1
            if count >= threshold:
                until, start, count = t + lease_ms, -1, 0
                out.append((key[0], t, until))
        state.update((start, count, until))
        end = max(until, start + window_ms if start >= 0 else -1)
        if end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end + 1)
        yield pd.DataFrame(out, columns=["doc_id", "lease_start", "lease_end"])

    keyed = reads.withWatermark("at", "1 hour").select("doc_id", "at", F.unix_millis("at").alias("ts_ms"))
    return keyed.groupBy("doc_id").applyInPandasWithState(step, "doc_id long, lease_start long, lease_end long", "start long, count long, until long", "append", GroupStateTimeout.EventTimeTimeout)
