"""Skewed Student-t densities of many keys: distribution on a grid, and its inversion.

A key's grid is rows, so keys and their points are spread over tasks. The
distribution is the running trapezoid sum of the density, scaled to reach one at
the grid's end, so the density needs no constant. Quantiles and probabilities are
looked up in the interval of the grid that brackets them, and interpolated.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Nodes of the rule that integrates the t distribution, from its generator.
NODES, WEIGHTS = (x.tolist() for x in np.polynomial.legendre.leggauss(20))


def _arc(upper: Column, degrees: Column) -> Column:
    """The integral of cos ** (degrees - 1) from 0 to upper."""
    total = F.lit(0.0)
    for node, weight in zip(NODES, WEIGHTS, strict=True):
        total = total + weight * F.pow(F.cos(upper * (0.5 + 0.5 * node)), degrees - 1)
    return total * upper / 2


def t_distribution(x: Column, degrees: Column) -> Column:
    """The Student-t distribution function for one degree of freedom or more, within 1e-8 up to 60 degrees."""
    return 0.5 + 0.5 * _arc(F.atan(x / F.sqrt(degrees)), degrees) / _arc(F.lit(math.pi / 2), degrees)


def skewed_grid(parameters: DataFrame, points: int = 4000) -> DataFrame:
    """(key, i, x, cdf) at evenly spaced points of (key, xi, omega, alpha, nu, low, high): location, scale, skew, degrees and the grid's ends.

    The density is that of t scaled by the distribution of t with one degree more at
    a skewed argument. Keys with a null parameter, or a scale that isn't positive, or
    high not above low, have no rows; points is 2 at least.
    """
    sound = F.greatest("omega", F.lit(0.0)) * F.greatest(F.col("high") - F.col("low"), F.lit(0.0)) > 0
    known = parameters.na.drop(subset=["xi", "omega", "alpha", "nu", "low", "high"]).filter(sound)
    rows = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    rows = rows.withColumn("step", (F.col("high") - F.col("low")) / (points - 1)).withColumn("x", F.col("low") + F.col("i") * F.col("step"))
    rows = rows.withColumn("z", (F.col("x") - F.col("xi")) / F.col("omega"))
    shape = F.pow(1 + F.col("z") * F.col("z") / F.col("nu"), -(F.col("nu") + 1) / 2)
    lean = t_distribution(F.col("alpha") * F.col("z") * F.sqrt((F.col("nu") + 1) / (F.col("z") * F.col("z") + F.col("nu"))), F.col("nu") + 1)
    rows = rows.select("key", "i", "x", "step", (shape * lean).alias("pdf"))
    along = Window.partitionBy("key").orderBy("i")  # a key's grid
    area = F.coalesce((F.col("pdf") + F.lag("pdf").over(along)) / 2 * F.col("step"), F.lit(0.0))
    rows = rows.withColumn("area", area).withColumn("sum", F.sum("area").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = F.sum("area").over(Window.partitionBy("key"))
    return rows.select("key", "i", "x", (F.col("sum") / whole).alias("cdf"))


def _intervals(grid: DataFrame) -> DataFrame:
    along = Window.partitionBy("key").orderBy("i")
    return grid.select("key", "i", "x", "cdf", F.lead("x").over(along).alias("next_x"), F.lead("cdf").over(along).alias("next_cdf")).filter("next_x IS NOT NULL")


def quantiles_of(grid: DataFrame, levels: list[float]) -> DataFrame:
    """(key, tau, q): the inverted distribution at levels between 0 and 1; level 1 is the grid's end."""
    rows = _intervals(grid)
    inside = F.filter(F.array(*map(F.lit, levels)), lambda t: ((F.col("cdf") <= t) & (t < F.col("next_cdf"))) | ((t == 1) & (F.col("cdf") < 1) & (F.col("next_cdf") >= 1)))
    found = rows.select("*", F.explode(inside).alias("tau"))
    share = (F.col("tau") - F.col("cdf")) / (F.col("next_cdf") - F.col("cdf"))
    return found.select("key", "tau", (F.col("x") + share * (F.col("next_x") - F.col("x"))).alias("q"))


def probabilities_of(grid: DataFrame, values: DataFrame) -> DataFrame:
    """values (key, value, ...) with pit, the distribution at the value: 0 below the grid, 1 above, null for a null value or a key without a grid.

    Each value meets the one interval that holds it: its number follows from the even spacing.
    """
    ends = grid.groupBy("key").agg(F.min("x").alias("_low"), F.max("x").alias("_high"), F.max("i").alias("_last"))
    placed = values.join(ends, "key", "left").withColumn("_at", F.floor((F.col("value") - F.col("_low")) / (F.col("_high") - F.col("_low")) * F.col("_last")))
    placed = placed.withColumn("_i", F.greatest(F.lit(0), F.least(F.col("_last") - 1, F.col("_at"))).cast("int"))
    rows = _intervals(grid).withColumnRenamed("i", "_i")
    met = placed.join(rows, ["key", "_i"], "left")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - F.col("x")) / (F.col("next_x") - F.col("x"))))
    pit = F.when(F.col("value").isNotNull(), F.col("cdf") + share * (F.col("next_cdf") - F.col("cdf")))
    return met.select(*values.columns, pit.alias("pit"))
