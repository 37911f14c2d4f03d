"""Series transforms as window expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Transform codes: level, difference, second difference, log, log difference, its difference, relative change.
CODES = (1, 2, 3, 4, 5, 6, 7)
#: Weights with which five months' factors make a quarter's growth rate.
QUARTER_WEIGHTS = (1 / 3, 2 / 3, 1.0, 2 / 3, 1 / 3)
#: Coefficients of the error function's approximation (fixed values).
NORMAL_P, NORMAL_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def stationary(value: Column, code: Column, window) -> Column:
    """The value under its transform code, along the window's order; an unknown code raises.

    The window must run over a dense calendar, else a gap counts as one step.
    Logarithms of values that aren't positive are null.
    """
    log = F.when(value > 0, F.log(value))
    back = lambda x, n: F.lag(x, n).over(window)
    second = lambda x: x - 2 * back(x, 1) + back(x, 2)
    return (
        F.when(code == 1, value)
        .when(code == 2, value - back(value, 1))
        .when(code == 3, second(value))
        .when(code == 4, log)
        .when(code == 5, log - back(log, 1))
        .when(code == 6, second(log))
        .when(code == 7, value / F.nullif(back(value, 1), F.lit(0.0)) - 1)
        .otherwise(F.raise_error(F.concat(F.lit("unknown transform code "), code.cast("string"))).cast("double"))
    )


def standardise(panel: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """panel with mean, std and z of each key group: sample deviation, 1 if it is zero, and 0 and 1 below two values."""
    window = Window.partitionBy(*keys)
    n = F.count(value).over(window)
    mean = F.when(n < 2, F.lit(0.0)).otherwise(F.avg(value).over(window))
    std = F.when(n < 2, F.lit(1.0)).otherwise(F.coalesce(F.nullif(F.stddev_samp(value).over(window), F.lit(0.0)), F.lit(1.0)))
    return panel.withColumn("mean", mean).withColumn("std", std).withColumn("z", (F.col(value) - F.col("mean")) / F.col("std"))


def quarter_aggregate(value: Column, window) -> Column:
    """Weighted sum of the last five months; null before there are five."""
    return sum((F.lit(w) * F.lag(value, k).over(window) for k, w in enumerate(QUARTER_WEIGHTS)), F.lit(0.0))


def quarter_fill(quarters: DataFrame, keys: list[str], date: str = "date", value: str = "value") -> DataFrame:
    """quarters with `monthly`, the value for each of a quarter's months.

    The first observed quarter has a third of its value; each later one has half of
    what its value exceeds the one before it. A quarter that isn't observed is
    skipped, not reset. The recursion is the closed sum
    m_k = (-1/2)^k (x_0 / 3 + sum over 1 <= j <= k of (-1/2)^-j x_j / 2), here over
    the group's ordered values, so that no term overflows.
    """
    observed = quarters.filter(F.col(value).isNotNull())
    window = Window.partitionBy(*keys).orderBy(date)
    so_far = F.collect_list(value).over(window)
    step = lambda a, x: F.when(a.isNull(), x / 3).otherwise((x - a) / 2)
    made = observed.withColumn("monthly", F.aggregate(so_far, F.lit(None).cast("double"), step))
    return quarters.join(made.select(*keys, date, "monthly"), [*keys, date], "left")


def destandardised(z: Column, mean: Column, std: Column) -> Column:
    """The value that standardise turned into z."""
    return z * std + mean


def normal_cdf(x: Column) -> Column:
    """The standard normal's distribution function by Abramowitz and Stegun 7.1.26, within 1e-7."""
    t = 1 / (1 + NORMAL_P * F.abs(x) / math.sqrt(2))
    tail = F.lit(0.0)
    for a in reversed(NORMAL_A):
        tail = (tail + a) * t
    half = 0.5 * tail * F.exp(-x * x / 2)
    return F.when(x >= 0, 1 - half).otherwise(half)
