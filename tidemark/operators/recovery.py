"""Scores of recovered against true quantities, as relations of weights, loadings and replications."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matrices as X
from .moments import matrices_of
from .quantiles import exact_quantiles


def bottom_overlap(weights: DataFrame, share: float = 0.1) -> DataFrame:
    """How well the k least w_hat find the k least w_true, by key; the first date of a key is left out.

    (key, t_eff, k, overlap, expected, lift, spearman): spearman ranks severity
    among the true k, with average ranks for ties. Ties at the border go to the
    earlier date.
    """
    own = Window.partitionBy("key")
    rows = weights.withColumn("nth", F.row_number().over(own.orderBy("date"))).filter("nth > 1")
    rows = rows.withColumn("t_eff", F.count(F.lit(1)).over(own))
    rows = rows.withColumn("k", F.greatest(F.lit(1), F.bround(F.col("t_eff") * share).cast("int")))
    rank = lambda w: F.row_number().over(own.orderBy(w, "date"))
    rows = rows.withColumn("r_true", rank("w_true")).withColumn("r_hat", rank("w_hat"))
    top = rows.filter(F.col("r_true") <= F.col("k"))
    average = lambda w: F.rank().over(own.orderBy(w)) + (F.count(F.lit(1)).over(Window.partitionBy("key", w)) - 1) / 2
    top = top.withColumn("a_true", average("w_true")).withColumn("a_hat", average("w_hat"))
    return top.groupBy("key", "t_eff", "k").agg(
        (F.sum((F.col("r_hat") <= F.col("k")).cast("int")) / F.max("k")).alias("overlap"),
        (F.max("k") / F.max("t_eff")).alias("expected"),
        (F.sum((F.col("r_hat") <= F.col("k")).cast("int")) / F.max("k") / (F.max("k") / F.max("t_eff"))).alias("lift"),
        F.corr("a_true", "a_hat").alias("spearman"),
    )


def detection(weights: DataFrame, shares: tuple[float, ...] = (0.05, 0.10)) -> DataFrame:
    """Recall, precision and lift of flagging the least w_hat as contaminated, at k = all contaminated and at shares.

    (key, tag, k, n_contaminated, recall, precision, lift). Keys without
    contamination or with constant weights have no rows, as nothing is ranked.
    """
    own = Window.partitionBy("key")
    rows = weights.withColumn("nth", F.row_number().over(own.orderBy("date"))).filter("nth > 1")
    rows = rows.withColumn("r", F.row_number().over(own.orderBy("w_hat", "date")))
    rows = rows.withColumn("t", F.count(F.lit(1)).over(own)).withColumn("m", F.sum(F.col("contaminated").cast("long")).over(own))
    rows = rows.withColumn("span", F.max("w_hat").over(own) - F.min("w_hat").over(own)).filter("m > 0 AND span > 0")
    fixed = [F.struct(F.lit(f"{round(s * 100)}pct").alias("tag"), F.greatest(F.lit(1).cast("long"), F.bround(F.col("t") * s).cast("long")).alias("k")) for s in shares]
    at = F.explode(F.array(F.struct(F.lit("natural").alias("tag"), F.col("m").alias("k")), *fixed))
    each = rows.select("*", at.alias("at")).select("*", "at.tag", "at.k")
    hits = F.sum((F.col("contaminated") & (F.col("r") <= F.col("k"))).cast("long"))
    found = each.groupBy("key", "tag", "k", F.col("m").alias("n_contaminated"), "t").agg(hits.alias("hits"))
    recall = F.col("hits") / F.col("n_contaminated")
    return found.select("key", "tag", "k", "n_contaminated", recall.alias("recall"), (F.col("hits") / F.col("k")).alias("precision"), (recall / (F.col("k") / F.col("t"))).alias("lift"))


def block_rotation(loadings: DataFrame) -> DataFrame:
    """(block, h, sign, error): the scale that fits loadings to the true ones by block, its sign, and the relative error after it."""
    own = Window.partitionBy("block")
    h = F.sum(F.col("hat") * F.col("star")).over(own) / F.sum(F.col("hat") * F.col("hat")).over(own)
    rows = loadings.withColumn("h", h)
    return rows.groupBy("block", "h").agg(
        F.signum("h").alias("sign"),
        (F.sqrt(F.sum((F.col("hat") * F.col("h") - F.col("star")) ** 2)) / F.sqrt(F.sum(F.col("star") ** 2))).alias("error"),
    )


def free_rotation(loadings: DataFrame) -> DataFrame:
    """(fit, names, rotation, error): the rotation that brings hat nearest star, and the relative distance after it, of many fits at once.

    loadings: (fit, series, factor, hat, star). Rotations mix all factors, in the
    order of names. Cells that lack are 0; cross products are summed before they
    meet, so series may be many. The rotation is null if the products are singular;
    reflections are allowed.
    """
    by_series = loadings.groupBy("fit", "series").agg(F.collect_list(F.struct("factor", "hat", "star")).alias("f"))
    left = by_series.select("fit", "f", F.explode("f").alias("x"))
    cells = left.select("fit", F.col("x.factor").alias("row"), F.col("x.hat").alias("hat"), F.explode("f").alias("y")).groupBy("fit", "row", F.col("y.factor").alias("col"))
    products = cells.agg(F.sum(F.col("hat") * F.col("y.star")).alias("cross"), F.sum(F.col("hat") * F.col("y.hat")).alias("own"))
    total = loadings.groupBy("fit").agg(F.sum(F.col("star") * F.col("star")).alias("star2"))
    m = matrices_of(products, ["fit"], "row", "col", ["cross", "own"]).withColumn("rotation", X.polar(F.col("cross"))).join(total, "fit")
    trace = lambda a: F.aggregate(F.transform(a, lambda row, i: row[i]), F.lit(0.0), lambda s, x: s + x)
    # |hat R - star|^2 = |hat|^2 - 2 tr(R' hat' star) + |star|^2, as R is orthogonal
    off = trace(F.col("own")) - 2 * trace(X.product(X.transposed(F.col("rotation")), F.col("cross"))) + F.col("star2")
    return m.select("fit", "names", "rotation", (F.sqrt(F.greatest(F.lit(0.0), off)) / F.sqrt(F.nullif(F.col("star2"), F.lit(0.0)))).alias("error"))


def replication_summary(metrics: DataFrame, truths: DataFrame, errors: str = "relerr|err_norm") -> DataFrame:
    """(scenario, metric, n, mean, std, median, q05, q95, bias, rmse) over finite values.

    metrics: (scenario, metric, value); truths: (metric, truth), few rows. Bias and
    rmse are against the truth where there is one. Metrics that are errors, by the
    pattern `errors`, have an rmse against zero; others without a truth have none.
    Quantiles are exact and no group meets in one task, see exact_quantiles.
    """
    finite = metrics.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    rows = finite.join(truths, "metric", "left")
    off = F.when(F.col("metric").rlike(errors), F.col("value") - F.coalesce(F.col("truth"), F.lit(0.0))).otherwise(F.col("value") - F.col("truth"))
    moments = rows.groupBy("scenario", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.avg(F.col("value") - F.col("truth")).alias("bias"), F.sqrt(F.avg(off * off)).alias("rmse")
    )
    own = exact_quantiles(finite, ["scenario", "metric"], "value", {"median": 0.5, "q05": 0.05, "q95": 0.95})
    columns = ["scenario", "metric", "n", "mean", "std", "median", "q05", "q95", "bias", "rmse"]
    return moments.join(own.withColumnsRenamed({"scenario": "_s", "metric": "_m"}), F.col("scenario").eqNullSafe(F.col("_s")) & F.col("metric").eqNullSafe(F.col("_m"))).select(*columns)


def trend(summary: DataFrame, levels: list[str]) -> DataFrame:
    """metric x scenario means, and whether they grow or fall from the first to the last."""
    wide = summary.groupBy("metric").pivot("scenario", levels).agg(F.first("mean"))
    first, last = F.col(f"`{levels[0]}`"), F.col(f"`{levels[-1]}`")
    return wide.withColumn("verdict", F.when(last > first, "GROWS").when(last < first, "FALLS").otherwise("FLAT"))


def rearranged(quantiles: DataFrame) -> DataFrame:
    """(key, tau, q, crossed): each key's quantiles sorted so that they grow with tau; crossed if they did not."""
    by_tau = Window.partitionBy("key").orderBy("tau")
    rows = quantiles.withColumn("nth", F.row_number().over(by_tau)).withColumn("fell", F.coalesce(F.col("q") < F.lag("q").over(by_tau), F.lit(False)))
    values = quantiles.select("key", F.col("q").alias("sorted"), F.row_number().over(Window.partitionBy("key").orderBy("q")).alias("nth"))
    crossed = F.max("fell").over(Window.partitionBy("key"))
    return rows.withColumn("crossed", crossed).join(values, ["key", "nth"]).select("key", "tau", F.col("sorted").alias("q"), "crossed")


def check_loss(rows: DataFrame) -> DataFrame:
    """(tau, n, loss, loss_constant, pseudo_r): quantile loss of q, that of the constant quantile c, and one less their ratio."""
    loss = lambda q: F.sum((F.col("y") - F.col(q)) * (F.col("tau") - (F.col("y") < F.col(q)).cast("double")))
    table = rows.groupBy("tau").agg(F.count(F.lit(1)).alias("n"), loss("q").alias("loss"), loss("c").alias("loss_constant"))
    return table.withColumn("pseudo_r", 1 - F.col("loss") / F.nullif(F.col("loss_constant"), F.lit(0.0)))


def share_below(points: DataFrame, value: str, draws: DataFrame, draw: str, bins: int = 1000) -> DataFrame:
    """points with pit, the share of the draws at or below their value: null for a value that is null or NaN, or without draws; such draws don't count.

    Equal draws are counted first. Both sides are dealt to `bins` equal ranges of the
    draws; a point takes the whole ranges below its own from their running count, a
    row for each range, and ranks within its own range alone, so no task holds all.
    """
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    counted = draws.select(number(draw).alias("_v")).filter("_v IS NOT NULL").groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    ends = F.broadcast(counted.agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_n").alias("_all")))  # one row
    place = F.floor(F.coalesce((F.col("_v") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)), F.lit(0.0)) * bins)
    binned = lambda df: df.join(ends).withColumn("_bin", F.greatest(F.lit(-1), F.least(F.lit(bins), place)))
    held = binned(counted).select("_bin", "_v", "_n")
    upto = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, after aggregation
    before = held.groupBy("_bin").agg(F.sum("_n").alias("_n")).unionByName(binned(points.select(number(value).alias("_v"))).select("_bin").distinct().withColumn("_n", F.lit(0).cast("long")))
    before = before.groupBy("_bin").agg(F.sum("_n").alias("_n")).select("_bin", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    own = binned(points.withColumn("_v", number(value)))
    both = own.withColumn("_n", F.lit(0).cast("long")).withColumn("_point", F.lit(True)).unionByName(held.withColumn("_point", F.lit(False)), allowMissingColumns=True)
    ranked = both.withColumn("_in", F.sum("_n").over(Window.partitionBy("_bin").orderBy("_v").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    share = F.when(F.col("_v").isNotNull(), (F.col("_before") + F.col("_in")) / F.col("_all"))
    return ranked.filter("_point").join(before, "_bin", "left").select(*points.columns, share.alias("pit"))


def pit_verdict(pit):
    """inside, edge or outside of a predictive density."""
    return F.when(pit.between(0.005, 0.5), "inside").when(pit > 1e-4, "edge").otherwise("outside")


def advantage(summary: DataFrame, reference: str) -> DataFrame:
    """(metric, scenario, mean, advantage, gap): how far the reference's mean is above a scenario's, and the scenario's relative distance from it."""
    base = summary.filter(F.col("scenario") == reference).select("metric", F.col("mean").alias("base"))
    joined = summary.join(base, "metric")  # a row for each metric
    return joined.select("metric", "scenario", "mean", (F.col("base") - F.col("mean")).alias("advantage"), (F.col("mean") / F.nullif(F.col("base"), F.lit(0.0)) - 1).alias("gap"))


def side_by_side(summary: DataFrame, scenarios: list[str], measure: str = "mean") -> DataFrame:
    """One row for each metric, with a column for each named scenario."""
    return summary.groupBy("metric").pivot("scenario", scenarios).agg(F.first(measure))


def least_squares_two(rows: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """(n, slope_1, slope_2, intercept, r2) of y on two predictors, from sums that are combined before they meet; null if they are collinear."""
    used = rows.filter(" AND ".join(f"{c} IS NOT NULL" for c in (y, x1, x2)))
    c = lambda a, b: F.covar_pop(a, b)
    s = used.agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate((y, x1, x2))], c(x1, x1).alias("s11"), c(x2, x2).alias("s22"), c(x1, x2).alias("s12"), c(x1, y).alias("s1y"), c(x2, y).alias("s2y"), c(y, y).alias("syy"))
    det = F.nullif(F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12"), F.lit(0.0))
    s = s.withColumn("slope_1", (F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y")) / det).withColumn("slope_2", (F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y")) / det)
    intercept = F.col("m0") - F.col("slope_1") * F.col("m1") - F.col("slope_2") * F.col("m2")
    r2 = (F.col("slope_1") * F.col("s1y") + F.col("slope_2") * F.col("s2y")) / F.nullif(F.col("syy"), F.lit(0.0))
    return s.select("n", "slope_1", "slope_2", intercept.alias("intercept"), r2.alias("r2"))
