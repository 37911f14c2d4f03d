"""Exact quantiles of any groups by distributed selection.

Each wanted rank starts with its group's whole range of values. A round cuts every
range that still holds too many values into BINS bins, counts the rows of each, and
keeps for each rank the one bin that holds it, with its least and greatest value. A
round is one scan with partial sums; only counts are shuffled. Rounds cut evenly
and on a logarithmic scale by turns, so values of many magnitudes need few.
What remains of a range, LEAST values at most, is ranked at last. No group meets in
one task, and a value that fills a range ends its search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, materialise, measured, scope, sized

BINS = 2048
#: Rows that a range may hold when its values are ranked by themselves.
LEAST = 50_000


def _scaled(v: Column, logarithmic: bool) -> Column:
    """A rising function of v: v / 2, or the signed logarithm of its size over 1e-300."""
    if not logarithmic:
        return v / 2
    return F.signum(v) * F.when(F.abs(v) > 1e-290, F.log(F.abs(v)) + 690.8).otherwise(F.log1p(F.abs(v) * 1e300))


def _bin(v: Column, low: Column, high: Column, logarithmic: bool) -> Column:
    a, b = _scaled(low, logarithmic), _scaled(high, logarithmic)
    share = (_scaled(v, logarithmic) - a) / F.nullif(b - a, F.lit(0.0))
    # a range too narrow for the scale is parted at its least value
    return F.coalesce(F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(share * BINS))), F.when(v > low, 1).otherwise(0)).cast("int")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """keys, n and a column for each name of levels: the quantile by linear interpolation between the two nearest ranks.

    Null keys are a group like others. Values that are null or NaN are left out,
    infinite ones count as the greatest finite doubles; groups without values have
    no row. No keys make one group. Rows are read once for each round, and rounds
    grow with the logarithm of a group's size, so a costly input should be stored
    first. Building the result runs these jobs.
    """
    with scope(rows.sparkSession) as own:
        return own.keep(_select(rows, keys, value, levels))


def _select(rows: DataFrame, keys: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    names = [f"_k{i}" for i in range(len(keys))]
    greatest = 1.7976931348623157e308
    number = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    data = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.greatest(F.lit(-greatest), F.least(F.lit(greatest), number)).alias("_v"))
    data = data.filter(number.isNotNull()).withColumn("_v", F.col("_v") + F.lit(0.0))
    groups = materialise(data.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")), "groups")
    # wanted ranks, from 0, of each group: those around each level's place
    places = [F.struct(F.lit(name).alias("_name"), ((F.col("_n") - 1) * F.lit(float(p))).alias("_place")) for name, p in levels.items()]
    wanted = groups.select(*names, "_n", F.explode(F.array(*places)).alias("w")).select(*names, "_n", "w.*")
    ranks = wanted.select(*names, F.explode(F.array(F.floor("_place"), F.ceil("_place"))).alias("_rank")).distinct()
    # (keys, rank, low, high, before, n): the range of values that holds a rank, rows below it and in it
    ranges = ranks.join(_renamed(groups, names), _same(names), "inner").select(*names, "_rank", "_low", "_high", F.lit(0).cast("long").alias("_before"), "_n")
    still = (F.col("_n") > LEAST) & (F.col("_low") < F.col("_high"))
    ranges = materialise(ranges, "ranges", groups, most=F.count(F.when(still, 1)))
    round_ = 0
    while measured(ranges, "most"):
        before = ranges
        ranges = materialise(_narrowed(data, ranges, names, still, round_ % 2 == 1), "ranges", before, most=F.count(F.when(still, 1)))
        discard(before)
        round_ += 1
    found = _ranked(data, ranges, names)
    at = wanted.join(_renamed(found, names, "_rank", "_value"), _same(names) & F.col("_r_rank").isin(F.floor("_place"), F.ceil("_place")))
    low = F.max(F.when(F.col("_r_rank") == F.floor("_place"), F.col("_r_value")))
    high = F.max(F.when(F.col("_r_rank") == F.ceil("_place"), F.col("_r_value")))
    each = at.groupBy(*names, "_n", "_name", "_place").agg((low + (high - low) * (F.col("_place") - F.floor("_place"))).alias("_q"))
    wide = each.groupBy(*names, "_n").agg(*[F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in levels])
    return materialise(wide.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.col("_n").alias("n"), *levels), "quantiles", groups)


def _renamed(df: DataFrame, names: list[str], *more: str) -> DataFrame:
    """df's columns under other names, so that null keys can meet by null-safe equality."""
    others = more or [c for c in df.columns if c not in names]
    return df.select(*[F.col(n).alias(f"_r{n}") for n in names], *[F.col(c).alias(f"_r{c}" if more else c) for c in others])


def _same(names: list[str]) -> Column:
    met = F.lit(True)
    for n in names:
        met = met & F.col(n).eqNullSafe(F.col(f"_r{n}"))
    return met


def _within(data: DataFrame, ranges: DataFrame, names: list[str], *more: str) -> DataFrame:
    """Rows of data that lie in a range, with it; ranges of a group are disjoint, so a row lies in one at most."""
    distinct = ranges.select(*names, "_low", "_high", *more).distinct()
    right = _renamed(distinct, names, "_low", "_high", *more)
    inside = (F.col("_v") >= F.col("_r_low")) & (F.col("_v") <= F.col("_r_high"))
    return data.join(sized(right, ranges), _same(names) & inside).select(*names, "_v", F.col("_r_low").alias("_low"), F.col("_r_high").alias("_high"), *[F.col(f"_r{c}").alias(c) for c in more])


def _narrowed(data: DataFrame, ranges: DataFrame, names: list[str], still: Column, logarithmic: bool) -> DataFrame:
    """ranges with those that hold too many rows cut to the bin that has their rank."""
    open_ = ranges.filter(still)
    rows = _within(data, open_, names)
    binned = rows.groupBy(*names, "_low", "_high", _bin(F.col("_v"), F.col("_low"), F.col("_high"), logarithmic).alias("_bin"))
    counts = binned.agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
    upto = Window.partitionBy(*names, "_low", "_high").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows at most
    counts = counts.withColumn("_below", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    right = _renamed(counts, names, "_low", "_high", "_from", "_to", "_n", "_below")
    rank = F.col("_rank") - F.col("_before")
    holds = (F.col("_r_below") <= rank) & (rank < F.col("_r_below") + F.col("_r_n"))
    met = open_.join(right, _same(names) & (F.col("_low") == F.col("_r_low")) & (F.col("_high") == F.col("_r_high")) & holds)
    cut = met.select(*names, "_rank", F.col("_r_from").alias("_low"), F.col("_r_to").alias("_high"), (F.col("_before") + F.col("_r_below")).alias("_before"), F.col("_r_n").alias("_n"))
    return cut.unionByName(ranges.filter(~still))


def _ranked(data: DataFrame, ranges: DataFrame, names: list[str]) -> DataFrame:
    """(keys, rank, value) from ranges of one value, or of few rows, whose values are counted and ranked."""
    single = ranges.filter("_low = _high").select(*names, "_rank", F.col("_low").alias("_value"))
    few = ranges.filter("_low < _high")
    counts = _within(data, few, names, "_before").groupBy(*names, "_low", "_high", "_before", "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*names, "_low", "_high").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)  # LEAST rows at most
    placed = counts.withColumn("_below", F.col("_before") + F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    right = _renamed(placed, names, "_low", "_high", "_v", "_below", "_n")
    holds = (F.col("_r_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_r_below") + F.col("_r_n"))
    met = few.drop("_n").join(right, _same(names) & (F.col("_low") == F.col("_r_low")) & (F.col("_high") == F.col("_r_high")) & holds)
    return single.unionByName(met.select(*names, "_rank", F.col("_r_v").alias("_value")))
