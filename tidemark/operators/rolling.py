"""The rolling calendar and the benchmarks that need no fitted model.

Published targets, as-of dates and targets in flight are small by nature: a row for
a month or quarter. The range join of as-of dates with releases broadcasts the
latter; joins on a key carry no hint, so their sides are broadcast by measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import horizon, quarter_end, quarter_label

METHODS = ("student_t", "gaussian", "arma22", "random_walk", "mean", "seasonal")


def as_of_dates(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(as_of): the 15th of every month from start to end, both 'YYYY-MM'."""
    months = spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}-01', date'{end}-01', interval 1 month)")).alias("m"))
    return months.select(F.date_add("m", 14).alias("as_of"))


def published(target: DataFrame, as_ofs: DataFrame, lag: int = 1) -> DataFrame:
    """(as_of, last_quarter): the last quarter end whose value is out, `lag` month ends after it. as_ofs with none are left out."""
    release = target.select(F.col("date").alias("quarter"), F.last_day(F.add_months("date", lag)).alias("release"))
    return as_ofs.join(F.broadcast(release), F.col("release") <= F.col("as_of")).groupBy("as_of").agg(F.max("quarter").alias("last_quarter"))


def in_flight(last_published: DataFrame) -> DataFrame:
    """(as_of, last_quarter, target_end): quarter ends after the last published one, up to as_of's own quarter."""
    first, last = F.add_months(F.date_add("last_quarter", 1), 2), quarter_end(F.col("as_of"))
    ends = F.when(F.last_day(first) <= last, F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 3 month")))
    return last_published.select("*", F.explode(ends).alias("m")).select("as_of", "last_quarter", F.last_day("m").alias("target_end"))


def rolling_calendar(target: DataFrame, as_ofs: DataFrame, lag: int = 1) -> DataFrame:
    """(as_of, last_quarter, target_end, target_quarter, horizon)."""
    rows = in_flight(published(target, as_ofs, lag))
    return rows.withColumn("target_quarter", quarter_label(F.col("target_end"))).withColumn("horizon", horizon(F.col("as_of"), F.col("target_end")))


def history_stats(target: DataFrame, last_published: DataFrame) -> DataFrame:
    """last_published with n, mean, std (sample), last_value and year_ago (four quarters before the next) of the values out then.

    The target is aggregated once over its own order with running windows, so the
    range join with all earlier quarters is never formed.
    """
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    stats = target.select(
        F.col("date").alias("last_quarter"),
        F.count("value").over(upto).alias("n"),
        F.avg("value").over(upto).alias("mean"),
        F.stddev_samp("value").over(upto).alias("std"),
        F.col("value").alias("last_value"),
    )
    return last_published.join(stats, "last_quarter")


def benchmark_facts(calendar: DataFrame, target: DataFrame) -> DataFrame:
    """The fact table of the benchmarks over a rolling calendar.

    random_walk: the last published value; mean: that of all published values;
    seasonal: the value a year before the target. z is by the published values'
    mean and sample deviation. Realised values join for scoring alone.
    """
    rows = history_stats(target, calendar)
    year_ago = target.select(F.last_day(F.add_months("date", 12)).alias("target_end"), F.col("value").alias("year_ago"))
    realised = target.select(F.col("date").alias("target_end"), F.col("value").alias("realised"))
    rows = rows.join(year_ago, "target_end", "left").join(realised, "target_end", "left")
    each = F.array(
        F.struct(F.lit("random_walk").alias("method"), F.col("last_value").alias("level")),
        F.struct(F.lit("mean").alias("method"), F.col("mean").alias("level")),
        F.struct(F.lit("seasonal").alias("method"), F.col("year_ago").alias("level")),
    )
    long = rows.select("*", F.explode(each).alias("m")).filter(F.col("m.level").isNotNull())
    spread = F.nullif(F.col("std"), F.lit(0.0))
    return long.select(
        "as_of",
        "target_quarter",
        "horizon",
        F.col("m.method").alias("method"),
        F.col("m.level").alias("nowcast_level"),
        ((F.col("m.level") - F.col("mean")) / spread).alias("nowcast_z"),
        "realised",
        (F.col("m.level") - F.col("realised")).alias("error"),
        F.lit(None).cast("double").alias("n_iter"),
        F.lit(True).alias("converged"),
    )


def ledger(work: DataFrame, vintages: DataFrame, results: DataFrame) -> DataFrame:
    """What a backtest writes: (as_of, target_quarter, horizon, method, nowcast_level, n_iter, converged) for each row of work.

    Months without a vintage (vintage_ym of the as_of's month) are skipped. Work
    without a result, or whose result has no level, has failed: n_iter is -1,
    converged false and the level null.
    """
    key = ["as_of", "target_quarter", "method"]
    ym = (F.year("as_of") * 100 + F.month("as_of")).alias("vintage_ym")
    able = work.select("*", ym).join(vintages.select("vintage_ym").distinct(), "vintage_ym", "left_semi")
    done = results.filter(F.col("nowcast_level").isNotNull()).select(*key, "nowcast_level", "n_iter", "converged")
    failed = F.col("nowcast_level").isNull()
    return able.join(done, key, "left").select(
        "as_of", "target_quarter", "horizon", "method", "nowcast_level",
        F.when(failed, F.lit(-1.0)).otherwise(F.col("n_iter")).alias("n_iter"),
        F.when(failed, F.lit(False)).otherwise(F.col("converged")).alias("converged"),
    )
