"""Queries over the event stream's table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.dates import month_end
from ..sources.levels import table
from ..streaming import windows
from .base import r


def month_end_resample(spark: SparkSession, sf: str):
    rows = table(spark, sf, "events")
    return rows.groupBy("event_type", month_end(F.col("ts").cast("date")).alias("date")).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def daily_resample(spark: SparkSession, sf: str):
    return windows.daily_means(table(spark, sf, "events"))


def hourly_windows(spark: SparkSession, sf: str):
    return windows.windowed(table(spark, sf, "events"), "6 hours", "2 hours")


def user_sessions(spark: SparkSession, sf: str):
    return windows.sessions(table(spark, sf, "events"), "12 hours")


QUERIES = {f.__name__: f for f in (month_end_resample, daily_resample, hourly_windows, user_sessions)}

SQL = {
    "month_end_resample": f"SELECT event_type, last_day(CAST(ts AS DATE)) AS date, {r('avg(value)', 'mean')}, count(value) AS n FROM events GROUP BY ALL",
    "daily_resample": f"SELECT event_type, CAST(ts AS DATE) AS date, {r('avg(value)', 'mean')}, count(value) AS n FROM events GROUP BY ALL",
    "hourly_windows": f"""SELECT event_type, s AS start, s + INTERVAL 6 HOUR AS stop, count(*) AS n, {r('avg(value)', 'mean')} FROM (SELECT event_type, value, ts, unnest([b, b - INTERVAL 2 HOUR, b - INTERVAL 4 HOUR]) AS s
        FROM (SELECT *, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') AS b FROM events)) GROUP BY ALL""",
    "user_sessions": """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS stop, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k""",
}
