"""Profiles of a panel: gaps, moments, correlations, and how blocks separate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gaps(panel: DataFrame) -> DataFrame:
    """For each series: n, n_missing, first and last valid date, and missing values before, within and after."""
    own = Window.partitionBy("series")
    valid = F.when(F.col("value").isNotNull(), F.col("date"))
    rows = panel.withColumn("first_valid", F.min(valid).over(own)).withColumn("last_valid", F.max(valid).over(own))
    missing = F.col("value").isNull()
    count = lambda test: F.sum(F.when(missing & test, 1).otherwise(0)).cast("long")
    return rows.groupBy("series", "first_valid", "last_valid").agg(
        F.count(F.lit(1)).alias("n"),
        count(F.lit(True)).alias("n_missing"),
        count(F.coalesce(F.col("date") < F.col("first_valid"), F.lit(True))).alias("leading"),
        count(F.col("date").between(F.col("first_valid"), F.col("last_valid"))).alias("internal"),
        count(F.col("date") > F.col("last_valid")).alias("trailing"),
    )


def gap_classes(panel: DataFrame) -> DataFrame:
    """panel with class: 0 present, 1 off a quarter's end, 2 ragged edge, 3 internal, 4 before the start."""
    own = Window.partitionBy("series")
    valid = F.when(F.col("value").isNotNull(), F.col("date"))
    first, last = F.min(valid).over(own), F.max(valid).over(own)
    kind = (
        F.when(F.col("value").isNotNull(), 0)
        .when(F.col("freq") == "quarterly", 1)
        .when(F.col("date") < first, 4)
        .when(F.col("date") > last, 2)
        .when(first.isNotNull(), 3)
        .otherwise(0)
    )
    return panel.withColumn("class", kind)


def describe(panel: DataFrame) -> DataFrame:
    """n, mean, std, quartiles, skewness and excess kurtosis (population) of each series."""
    q = lambda p: F.percentile("value", F.lit(p))
    return panel.groupBy("series").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        q(0.25).alias("p25"),
        q(0.5).alias("median"),
        q(0.75).alias("p75"),
        F.max("value").alias("max"),
        F.skewness("value").alias("skew"),
        F.kurtosis("value").alias("exkurt"),
    )


def pairs(panel: DataFrame, value: str = "value") -> DataFrame:
    """(a, b, date, x, y): values of each two series of one date, a <= b in name.

    A date's series meet in one row of arrays, so the data shuffle once and are not
    joined with themselves; a panel has few series on a date.
    """
    day = panel.filter(F.col(value).isNotNull()).groupBy("date").agg(F.array_sort(F.collect_list(F.struct(F.col("series").alias("s"), F.col(value).alias("v")))).alias("all"))
    one = day.select("date", "all", F.posexplode("all").alias("i", "p"))
    two = one.select("date", "p", F.explode(F.slice("all", F.col("i") + 1, F.size("all"))).alias("q"))
    return two.select(F.col("p.s").alias("a"), F.col("q.s").alias("b"), "date", F.col("p.v").alias("x"), F.col("q.v").alias("y"))


def correlations(panel: DataFrame, value: str = "value") -> DataFrame:
    """(a, b, n, corr) over the dates that both have."""
    return pairs(panel, value).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("corr"))


def gram(panel: DataFrame, value: str = "z") -> DataFrame:
    """(a, b, gram): sum of products over all dates, divided by the number of dates."""
    months = panel.agg(F.countDistinct("date").alias("t"))
    sums = pairs(panel, value).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    return sums.join(F.broadcast(months)).select("a", "b", (F.col("s") / F.col("t")).alias("gram"))


def residual_summary(residuals: DataFrame, value: str, above: float = 0.3) -> DataFrame:
    """One row: pairs, largest and mean absolute correlation of residuals, and the share above a bound."""
    off = correlations(residuals, value).filter((F.col("a") != F.col("b")) & F.col("corr").isNotNull())
    size = F.abs("corr")
    return off.agg(F.count(F.lit(1)).alias("pairs"), F.max(size).alias("largest"), F.avg(size).alias("mean"), F.avg(F.when(size > above, 1.0).otherwise(0.0)).alias("share"))


def block_factors(panel: DataFrame) -> DataFrame:
    """(block, date, factor): the mean of a block's standardised monthly series, a stand-in for a fitted factor."""
    return panel.filter("freq = 'monthly' AND z IS NOT NULL").groupBy("block", "date").agg(F.avg("z").alias("factor"))


def loadings(panel: DataFrame, factors: DataFrame) -> DataFrame:
    """(series, block, loading, residual_var): least squares of a series on its block's factor, and the residuals' sample variance."""
    rows = panel.filter("freq = 'monthly' AND z IS NOT NULL").join(factors, ["block", "date"])
    own = rows.groupBy("series", "block").agg((F.sum(F.col("z") * F.col("factor")) / F.sum(F.col("factor") * F.col("factor"))).alias("loading"))
    fitted = rows.join(own.select("series", "loading"), "series")
    return fitted.groupBy("series", "block", "loading").agg(F.var_samp(F.col("z") - F.col("loading") * F.col("factor")).alias("residual_var"))


def fitted(panel: DataFrame, factors: DataFrame) -> DataFrame:
    """panel's monthly rows with the block's factor, the fit and the residual."""
    own = loadings(panel, factors).select("series", "loading")
    rows = panel.filter("freq = 'monthly' AND z IS NOT NULL").join(factors, ["block", "date"]).join(own, "series")
    return rows.withColumn("fit", F.col("loading") * F.col("factor")).withColumn("residual", F.col("z") - F.col("fit"))


def own_r2(fits: DataFrame) -> DataFrame:
    """(series, block, r2, explained, unexplained): 1 - SSR / SST within 0 and 1, and the variance shares."""
    mean = F.avg("z").over(Window.partitionBy("series"))
    rows = fits.withColumn("mean_z", mean)
    sst = F.sum((F.col("z") - F.col("mean_z")) ** 2)
    r2 = 1 - F.sum(F.col("residual") ** 2) / F.nullif(sst, F.lit(0.0))
    variance = F.nullif(F.var_pop("z"), F.lit(0.0))
    return rows.groupBy("series", "block").agg(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), r2)).alias("r2"),
        (F.var_pop("fit") / variance).alias("explained"),
        (F.var_pop("residual") / variance).alias("unexplained"),
    )


def separation(panel: DataFrame, factors: DataFrame, least: int = 10) -> DataFrame:
    """(block, factor_block, mean_r2): the mean squared correlation of a block's series with each factor, over more than `least` dates."""
    f = factors.withColumnRenamed("block", "factor_block")
    rows = panel.filter("freq = 'monthly' AND z IS NOT NULL").join(f, "date")
    each = rows.groupBy("block", "series", "factor_block").agg(F.count(F.lit(1)).alias("n"), F.corr("z", "factor").alias("r"))
    return each.filter(F.col("n") > least).groupBy("block", "factor_block").agg(F.avg(F.col("r") * F.col("r")).alias("mean_r2"))
