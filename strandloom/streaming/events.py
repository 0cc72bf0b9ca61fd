"""Windowed aggregates over event streams; the same functions take batch tables.

An extension beyond the positional windows: tumbling, sliding and session windows on
event time, with a watermark for late rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """window_start, event_type, n, total of events (ts, event_type, value)."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    grouped = rows.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """user_id, first, last, n of runs of a user's events with gaps of at most ``gap``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    grouped = rows.groupBy("user_id", F.session_window("ts", gap))
    return grouped.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")).select("user_id", "first", "last", "n")
