"""Event-time windows, for tables and for streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.functions.columns import money


def _late(events: DataFrame, delay: str) -> DataFrame:
    """A stream's event time as Spark's watermarks ask for it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay) if events.isStreaming else events


def tumbling(events: DataFrame, width: str, delay: str = "1 hour") -> DataFrame:
    """start, event_type, n and total of each window; rows that come later than ``delay`` are left out of a stream."""
    return (_late(events, delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(money("value")).cast("double").alias("total"))
            .select(F.col("w.start").alias("start"), "event_type", "n", "total"))


def sessions(events: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """user_id, start, end and n of each run of a user's events without a gap."""
    return (_late(events, delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
            .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"))


def ledger(changes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The newest status of each job from its changes (job_id, ts, status); of changes at the same time the last by name."""
    newest = F.max(F.struct("ts", "status")).alias("newest")
    return _late(changes, delay).groupBy("job_id").agg(newest).select("job_id", "newest.status", "newest.ts")
