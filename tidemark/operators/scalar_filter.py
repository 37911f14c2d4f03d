"""A first-order scalar state, filtered and smoothed over many keys by prefix scans.

Filtering composes an element for each date, smoothing another one backwards; both
compositions are associative, so a key's dates need not be folded in one row or
task. Dates are cut into blocks of a stated number of days. Within a block the
elements are combined by doubling: each round a row takes in the one that stands
twice as far away, by window functions over the same partition, so rows are
shuffled once. The blocks' totals, a row for each block, are scanned the same way
and handed back to their blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a block.
BLOCK_DAYS = 1024

#: A filter element: the state given the one before it is A x + b with variance C; eta and J are what the data say of the one before.
FILTER = ("A", "b", "C", "eta", "J")
#: A smoother element: the state given the one after it is E x + g with variance L.
SMOOTHER = ("E", "g", "L")


def combine_filter(i: dict[str, Column], j: dict[str, Column]) -> dict[str, Column]:
    """i, then j."""
    d = 1 + i["C"] * j["J"]
    return {
        "A": j["A"] * i["A"] / d,
        "b": j["A"] * (i["b"] + i["C"] * j["eta"]) / d + j["b"],
        "C": j["A"] * j["A"] * i["C"] / d + j["C"],
        "eta": i["A"] * (j["eta"] - j["J"] * i["b"]) / d + i["eta"],
        "J": i["A"] * i["A"] * j["J"] / d + i["J"],
    }


def combine_smoother(later: dict[str, Column], own: dict[str, Column]) -> dict[str, Column]:
    return {"E": own["E"] * later["E"], "g": own["E"] * later["g"] + own["g"], "L": own["E"] * own["E"] * later["L"] + own["L"]}


def scanned(df: DataFrame, keys: list[str], order: list[Column], fields: tuple[str, ...], combine: Callable, longest: int) -> DataFrame:
    """df with fields replaced by their combination with those of all rows before, in groups of at most `longest` rows."""
    window = Window.partitionBy(*keys).orderBy(*order)
    for k in range(max(0, math.ceil(math.log2(max(1, longest))))):
        far = df.withColumns({f"_{f}": F.lag(f, 1 << k).over(window) for f in fields})
        first, own = ({f: F.col(p + f) for f in fields} for p in ("_", ""))
        made = combine(first, own)
        df = far.withColumns({f: F.when(F.col(f"_{fields[0]}").isNotNull(), made[f]).otherwise(F.col(f)) for f in fields}).drop(*[f"_{f}" for f in fields])
    return df


def _blocks(rows: DataFrame, block_days: int) -> tuple[DataFrame, int, int]:
    """(rows with their block, most rows of a block, most blocks of a key)."""
    cut = rows.select("key", "date", "y").withColumn("block", F.floor(F.unix_date("date") / block_days))
    counts = cut.groupBy("key", "block").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("key").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("blocks")).agg(F.max("n"), F.max("blocks")).first()
    return cut, most[0] or 1, most[1] or 1


def _filtered(rows: DataFrame, decay: float, shock: float, noise: float, block_days: int) -> tuple[DataFrame, int, int]:
    """(key, block, date, y, mean, variance, before_mean, before_variance, end_mean, end_variance): filtered states, those before them and the key's last."""
    cut, longest, blocks = _blocks(rows, block_days)
    seen, total = F.col("y").isNotNull(), shock + noise
    elements = cut.withColumns({
        "A": F.when(seen, decay * noise / total).otherwise(decay),
        "b": F.when(seen, shock / total * F.col("y")).otherwise(0.0),
        "C": F.when(seen, shock * noise / total).otherwise(shock),
        "eta": F.when(seen, decay / total * F.col("y")).otherwise(0.0),
        "J": F.when(seen, decay * decay / total).otherwise(0.0),
    })
    order = [F.col("date"), F.col("y")]
    within = scanned(elements, ["key", "block"], order, FILTER, combine_filter, longest)
    last = F.max_by(F.struct(*FILTER), F.struct("date", "y"))
    totals = within.groupBy("key", "block").agg(last.alias("e"))
    totals = scanned(totals.select("key", "block", "e.*"), ["key"], [F.col("block")], FILTER, combine_filter, blocks)
    # the state one step before a key's first date has mean zero and variance one
    prior = {"A": F.lit(0.0), "b": F.lit(0.0), "C": F.lit(1.0), "eta": F.lit(0.0), "J": F.lit(0.0)}
    whole = combine_filter(prior, {f: F.col(f) for f in FILTER})
    totals = totals.select("key", "block", whole["b"].alias("_mean"), whole["C"].alias("_variance"))
    by_key = Window.partitionBy("key").orderBy("block")
    end = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "key", "block",
        F.coalesce(F.lag("_mean").over(by_key), F.lit(0.0)).alias("start_mean"), F.coalesce(F.lag("_variance").over(by_key), F.lit(1.0)).alias("start_variance"),
        F.last("_mean").over(end).alias("end_mean"), F.last("_variance").over(end).alias("end_variance"),
    )
    joined = within.join(totals, ["key", "block"])
    start = prior | {"b": F.col("start_mean"), "C": F.col("start_variance")}
    state = combine_filter(start, {f: F.col(f) for f in FILTER})
    states = joined.select("key", "block", "date", "y", state["b"].alias("mean"), state["C"].alias("variance"), "start_mean", "start_variance", "end_mean", "end_variance")
    window = Window.partitionBy("key", "block").orderBy(*order)
    before = {f"before_{c}": F.coalesce(F.lag(c).over(window), F.col(f"start_{c}")) for c in ("mean", "variance")}
    return states.withColumns(before).drop("start_mean", "start_variance"), longest, blocks


def scalar_filter(rows: DataFrame, decay: float, shock: float, noise: float, block_days: int = BLOCK_DAYS) -> DataFrame:
    """(key, date, mean, variance, loglik): the filtered state after each date of rows (key, date, y), and the log-likelihood up to it.

    The state starts at zero with variance one, one step before a key's first date.
    A null y carries the prediction on. Rows are steps, whatever the time between
    them; rows of one date are steps in order of y, nulls first. shock and noise
    are positive. Empty tables give no rows. One small job counts the blocks.
    """
    states, _, _ = _filtered(rows, decay, shock, noise, block_days)
    predicted, total = decay * F.col("before_mean"), decay * decay * F.col("before_variance") + shock + noise
    error = F.col("y") - predicted
    term = F.when(F.col("y").isNotNull(), -0.5 * (math.log(2 * math.pi) + F.log(total) + error * error / total)).otherwise(0.0)
    scored = states.withColumn("term", term)
    window = Window.partitionBy("key", "block").orderBy("date", "y").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = scored.groupBy("key", "block").agg(F.sum("term").alias("sum"))
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("key", "block", F.coalesce(F.sum("sum").over(earlier), F.lit(0.0)).alias("earlier"))
    joined = scored.withColumn("own", F.sum("term").over(window)).join(blocks, ["key", "block"])
    return joined.select("key", "date", "mean", "variance", (F.col("earlier") + F.col("own")).alias("loglik"))


def scalar_smoother(rows: DataFrame, decay: float, shock: float, noise: float, block_days: int = BLOCK_DAYS) -> DataFrame:
    """(key, date, mean, variance, lag_one): the state at each date given all of a key's values, and its covariance with the state before.

    lag_one of a key's first date is its covariance with the state one step before.
    See scalar_filter for the model, nulls and ties.
    """
    states, longest, blocks = _filtered(rows, decay, shock, noise, block_days)

    def gain(mean: Column, variance: Column) -> tuple[Column, Column, Column]:
        ahead = decay * decay * variance + shock
        e = decay * variance / ahead
        return e, mean - e * decay * mean, variance - e * e * ahead

    e, g, low = gain(F.col("mean"), F.col("variance"))
    elements = states.withColumns({"E": e, "g": g, "L": low})
    order = [F.desc("date"), F.desc("y")]
    within = scanned(elements, ["key", "block"], order, SMOOTHER, combine_smoother, longest)
    first = F.min_by(F.struct(*SMOOTHER, "end_mean", "end_variance"), F.struct("date", "y"))
    totals = within.groupBy("key", "block").agg(first.alias("e")).select("key", "block", "e.*")
    totals = scanned(totals, ["key"], [F.desc("block")], SMOOTHER, combine_smoother, blocks)
    # after a key's last date stands its own prediction
    ahead = {"E": F.lit(0.0), "g": decay * F.col("end_mean"), "L": decay * decay * F.col("end_variance") + shock}
    whole = combine_smoother(ahead, {f: F.col(f) for f in SMOOTHER})
    totals = totals.select("key", "block", whole["g"].alias("_g"), whole["L"].alias("_L"), ahead["g"].alias("_end_g"), ahead["L"].alias("_end_L"))
    back = Window.partitionBy("key").orderBy(F.desc("block"))
    totals = totals.select("key", "block", F.coalesce(F.lag("_g").over(back), F.col("_end_g")).alias("after_g"), F.coalesce(F.lag("_L").over(back), F.col("_end_L")).alias("after_L"))
    joined = within.join(totals, ["key", "block"])
    state = combine_smoother({"E": F.lit(0.0), "g": F.col("after_g"), "L": F.col("after_L")}, {f: F.col(f) for f in SMOOTHER})
    before_e, _, _ = gain(F.col("before_mean"), F.col("before_variance"))
    return joined.select("key", "date", state["g"].alias("mean"), state["L"].alias("variance"), (state["L"] * before_e).alias("lag_one"))
