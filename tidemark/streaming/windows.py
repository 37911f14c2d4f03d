"""Windowed aggregates that read the same on a table and on a stream.

On a stream, `late` sets the watermark: rows later than that are dropped and
windows older than that are final, which bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def daily_means(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(event_type, date, mean, n) by day."""
    day = F.window("ts", "1 day")
    rows = _marked(events, late).groupBy("event_type", day.alias("w")).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return rows.select("event_type", F.col("w.start").cast("date").alias("date"), "mean", "n")


def windowed(events: DataFrame, length: str, slide: str, late: str = "1 hour") -> DataFrame:
    """(event_type, start, stop, n, mean) over sliding windows."""
    rows = _marked(events, late).groupBy("event_type", F.window("ts", length, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return rows.select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "mean")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(user_id, start, stop, n): runs of a user's events with less than `gap` between them; stop is the last plus the gap."""
    rows = _marked(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
