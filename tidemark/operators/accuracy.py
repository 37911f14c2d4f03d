"""Forecast accuracy of a fact table by method, horizon and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rolling import METHODS


def safe_corr(a: str, b: str) -> Column:
    """Correlation; null below two pairs or if either side is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    varies = lambda x: F.coalesce(F.stddev_pop(F.when(both, F.col(x))) > 0, F.lit(False))
    return F.when((F.count(F.when(both, F.lit(1))) >= 2) & varies(a) & varies(b), F.corr(a, b))


def scores() -> list[Column]:
    error = F.col("error")
    return [
        F.count("error").alias("n"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error).alias("bias"),
        safe_corr("nowcast_level", "realised").alias("corr"),
        F.avg("nowcast_z").alias("mean_z"),
        F.avg(F.abs("nowcast_z")).alias("mean_abs_z"),
    ]


def scored(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("realised").isNotNull() & F.col("nowcast_level").isNotNull())


def by_method(facts: DataFrame) -> DataFrame:
    return scored(facts).groupBy("method").agg(*scores())


def by_method_horizon(facts: DataFrame, benchmark: str = "random_walk") -> DataFrame:
    """Scores by method and horizon, and the error relative to the benchmark's at that horizon."""
    table = scored(facts).groupBy("method", "horizon").agg(*scores())
    base = F.max(F.when(F.col("method") == benchmark, F.col("rmse"))).over(Window.partitionBy("horizon"))
    return table.withColumn("rmse_relative", F.col("rmse") / F.nullif(base, F.lit(0.0)))


def cube(facts: DataFrame) -> DataFrame:
    """(method, horizon, period, n, rmse) for method x horizon, method and method x period, in one pass."""
    rows = scored(facts)
    return rows.groupingSets([["method", "horizon"], ["method"], ["method", "period"]], "method", "horizon", "period").agg(
        F.grouping_id("method", "horizon", "period").alias("grouping"), F.count("error").alias("n"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse")
    )


def by_period(facts: DataFrame, periods: list[str]) -> DataFrame:
    """method x period errors; the periods are given, so the pivot needs no extra pass."""
    return scored(facts).groupBy("method").pivot("period", periods).agg(F.sqrt(F.avg(F.col("error") * F.col("error"))))


def method_rank(method: Column) -> Column:
    """Known methods in their order, others behind."""
    at = F.array_position(F.array(*map(F.lit, METHODS)), method)
    return F.when(at == 0, F.lit(99)).otherwise(at)


def extremes(facts: DataFrame, k: int = 4) -> DataFrame:
    """At the k quarters of largest absolute realised value (ties by name): each method's row at the quarter's largest horizon."""
    rows = scored(facts)
    top = rows.groupBy("target_quarter").agg(F.max(F.abs("realised")).alias("size")).orderBy(F.desc("size"), "target_quarter").limit(k)
    own = rows.join(top.select("target_quarter"), "target_quarter", "left_semi")
    deep = own.withColumn("r", F.rank().over(Window.partitionBy("target_quarter").orderBy(F.desc("horizon")))).filter("r = 1")
    return deep.select("target_quarter", "realised", "horizon", "method", "nowcast_level", "nowcast_z", "error")


def realised_z(facts: DataFrame) -> DataFrame:
    """(as_of, slope, intercept): the line from z to level at each as_of, whose inverse gives a realised value's z."""
    rows = facts.filter(F.col("nowcast_z").isNotNull()).groupBy("as_of").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("nowcast_level", "nowcast_z").alias("slope"), F.regr_intercept("nowcast_level", "nowcast_z").alias("intercept")
    )
    return rows.filter((F.col("n") >= 2) & F.col("slope").isNotNull() & (F.abs("slope") > 1e-12))


def trajectories(facts: DataFrame, least_horizon: int = 1) -> DataFrame:
    """Rows of quarters and methods with two points or more, numbered by as_of, for drawing."""
    window = Window.partitionBy("target_quarter", "method")
    rows = facts.filter(F.col("horizon") >= least_horizon)
    return rows.withColumn("points", F.count(F.lit(1)).over(window)).withColumn("nth", F.row_number().over(window.orderBy("as_of"))).filter("points >= 2")
