"""Event-time windows that work on batch and streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, delay: str | None) -> DataFrame:
    return events.withWatermark("ts", delay) if events.isStreaming and delay else events


def tumbling(events: DataFrame, width: str, slide: str | None = None, delay: str | None = "10 minutes") -> DataFrame:
    """event_type, start, n, total of each window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = _late(events, delay).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str, delay: str | None = "10 minutes") -> DataFrame:
    """user_id, start, n of each session: events less than ``gap`` apart."""
    out = _late(events, delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")
