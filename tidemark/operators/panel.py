"""Panels: spreads, dense calendars, quarter masks, point-in-time truncation.

Joins on a key carry no hint: adaptive execution broadcasts a side by its measured
size. Hints stand at joins without a key alone, on registries and calendars, which
have a row for a series, a month or an as-of date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import last_complete_month, month_end, quarter_end
from ..functions.transforms import stationary


def spreads(levels: DataFrame, registry: DataFrame) -> DataFrame:
    """(series, date, value) of the registry's spreads: the first component less the second, on raw levels."""
    parts = registry.filter("source = 'spread'").select("name", F.posexplode("components").alias("side", "series"))
    joined = levels.join(parts, "series")
    sides = joined.groupBy("name", "date").agg(
        F.max(F.when(F.col("side") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("value"))).alias("b")
    )
    return sides.select(F.col("name").alias("series"), "date", (F.col("a") - F.col("b")).alias("value"))


def calendar(rows: DataFrame, until=None) -> DataFrame:
    """(date) of all month ends from the first to the last date in rows, or to `until` if that is later."""
    last = F.max("date") if until is None else F.greatest(F.max("date"), until)
    bounds = rows.agg(F.trunc(F.min("date"), "month").alias("a"), F.trunc(last, "month").alias("b"))
    return bounds.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("day")).select(month_end(F.col("day")).alias("date"))


def densify(rows: DataFrame, registry: DataFrame, until=None) -> DataFrame:
    """rows with every series of the registry at every month end, null where it has no value; registry's columns come along."""
    months = calendar(rows, until).agg(F.sort_array(F.collect_list("date")).alias("dates"))
    grid = registry.join(F.broadcast(months)).select("*", F.explode("dates").alias("date")).drop("dates")
    return grid.withColumnRenamed("name", "series").join(rows, ["series", "date"], "left")


def transformed(levels: DataFrame, registry: DataFrame) -> DataFrame:
    """Dense monthly series under their transform codes: the registry's columns, date, value."""
    every = levels.unionByName(spreads(levels, registry))
    monthly = registry.filter("freq = 'monthly'")
    known = every.join(monthly.select(F.col("name").alias("series")), "series", "left_semi")
    dense = densify(known, monthly)
    window = Window.partitionBy("series").orderBy("date")
    return dense.withColumn("value", stationary(F.col("value"), F.col("transform"), window))


def with_target(monthly: DataFrame, target: DataFrame, registry: DataFrame) -> DataFrame:
    """The panel: monthly series and the quarterly one, which is null off the last months of quarters."""
    quarterly = registry.filter("freq = 'quarterly'")
    dates = monthly.select("date").distinct()
    grid = dates.join(F.broadcast(quarterly)).withColumnRenamed("name", "series").join(target, "date", "left")
    masked = grid.withColumn("value", F.when(F.month("date").isin(3, 6, 9, 12), F.col("value")))
    return monthly.unionByName(masked)


def missing_series(levels: DataFrame, registry: DataFrame) -> DataFrame:
    """Names that the registry takes from a table and levels lack."""
    return registry.filter("source = 'table'").select("name").join(levels.select(F.col("series").alias("name")).distinct(), "name", "left_anti")


def code_mismatches(codes: DataFrame, registry: DataFrame) -> DataFrame:
    """(series, code, transform) where a vintage's code isn't the registry's."""
    own = registry.select(F.col("name").alias("series"), "transform")
    return codes.join(own, "series").filter(~F.col("code").eqNullSafe(F.col("transform"))).select("series", "code", "transform")


def known_on(panel: DataFrame, as_ofs: DataFrame) -> DataFrame:
    """The panel as it was known on each as_of: (as_of, series, ..., date, value), values not yet published left out.

    A monthly value is out `lag` months after its month; a quarterly one when the
    month end `lag` months after its quarter has passed.
    """
    dates = F.broadcast(as_ofs)
    monthly_until = F.last_day(F.add_months(last_complete_month(F.col("as_of")), -F.col("lag")))
    released = F.last_day(F.add_months(F.col("date"), F.col("lag")))
    out = F.when(F.col("freq") == "quarterly", released <= F.col("as_of")).otherwise(F.col("date") <= monthly_until)
    return panel.join(dates, out & F.col("value").isNotNull())


def cutoffs(registry: DataFrame, as_ofs: DataFrame) -> DataFrame:
    """(as_of, series, cutoff) of monthly series: the last month that is out."""
    each = registry.filter("freq = 'monthly'").join(F.broadcast(as_ofs))
    return each.select("as_of", F.col("name").alias("series"), F.last_day(F.add_months(last_complete_month(F.col("as_of")), -F.col("lag"))).alias("cutoff"))


def wide(panel: DataFrame, names: list[str]) -> DataFrame:
    """One row for each date with a column for each name; names are given, so the pivot needs no extra pass."""
    return panel.groupBy("date").pivot("series", names).agg(F.first("value"))


def contract(panel: DataFrame) -> DataFrame:
    """One row: whether all dates are month ends and quarterly values stand at quarter ends alone."""
    quarterly = F.coalesce((F.col("freq") == "quarterly") & F.col("value").isNotNull(), F.lit(False))
    return panel.agg(
        F.bool_and(F.col("date") == F.last_day("date")).alias("month_ends"),
        F.bool_and(~quarterly | (F.col("date") == quarter_end(F.col("date")))).alias("quarterly_at_quarter_ends"),
        F.countDistinct("series").alias("series"),
        F.countDistinct("date").alias("months"),
    )


def newly_known(vintages: DataFrame) -> DataFrame:
    """(vintage_ym, series, date) of values that a vintage has and the one before it lacks."""
    months = vintages.select("vintage_ym").distinct()
    order = months.withColumn("before", F.lag("vintage_ym").over(Window.orderBy("vintage_ym")))
    own = vintages.filter(F.col("value").isNotNull()).select("vintage_ym", "series", "date").join(order, "vintage_ym")
    prior = vintages.filter(F.col("value").isNotNull()).select(F.col("vintage_ym").alias("before"), "series", "date")
    return own.filter(F.col("before").isNotNull()).join(prior, ["before", "series", "date"], "left_anti").select("vintage_ym", "series", "date")


def largest_revision(first: DataFrame, second: DataFrame) -> DataFrame:
    """(series, n, largest): over the dates that both have, the largest absolute difference."""
    other = second.select("series", "date", F.col("value").alias("other"))
    return first.join(other, ["series", "date"]).groupBy("series").agg(F.count("other").alias("n"), F.max(F.abs(F.col("value") - F.col("other"))).alias("largest"))


def metadata(panel: DataFrame) -> DataFrame:
    """(series, block, freq, lag, months, n, missing_share, first_date, last_date) of a dense panel; the dates are those with a value."""
    known = F.when(F.col("value").isNotNull(), F.col("date"))
    return panel.groupBy("series", "block", "freq", "lag").agg(
        F.count(F.lit(1)).alias("months"), F.count("value").alias("n"), (1 - F.count("value") / F.count(F.lit(1))).alias("missing_share"), F.min(known).alias("first_date"), F.max(known).alias("last_date")
    )


def missing_pattern(registry: DataFrame, dates: DataFrame, on_time: list[str]) -> DataFrame:
    """(series, date, missing): quarterly series are missing off the last months of quarters; others, but those on time, at their lag's last months."""
    last = dates.agg(F.max("date").alias("last"))
    grid = registry.select(F.col("name").alias("series"), "freq", "lag").join(F.broadcast(last)).join(F.broadcast(dates))
    tail = ~F.col("series").isin(*on_time) & (F.col("date") > F.last_day(F.add_months("last", -F.col("lag"))))
    off = (F.col("freq") == "quarterly") & ~F.month("date").isin(3, 6, 9, 12)
    return grid.select("series", "date", (tail | off).alias("missing"))
