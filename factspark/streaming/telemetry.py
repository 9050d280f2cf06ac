"""Event-time telemetry; the same plans run over batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(events: DataFrame, at: str = "ts") -> DataFrame:
    """ts as TIMESTAMP, which watermarks need."""
    return events.withColumn(at, F.col(at).cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each window and type; late rows are dropped by the watermark when streaming."""
    timed = event_time(events)
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """One row a user and run of events with no longer gap."""
    timed = event_time(events)
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")
