"""Block factors without dynamics, fitted by EM for many fits at once, as a relational iteration.

A series is its loading times its block's factor plus noise; factors are standard
normal, independent over dates. A round is an aggregation by block and date, which
gives the factors' means and variances, and one by series, which gives loadings and
noise, by the sums that other fits use. Parameters are written each round, so a
lost executor's work is not computed from the start. Fits whose likelihood has
settled leave the iteration by an anti-join; the others go on.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialise, measured, scope
from .moments import updated_loadings

#: Noise variances don't fall below this, which a series that its factor explains fully would reach.
LEAST_NOISE = 1e-6


def factor_moments(rows: DataFrame, parameters: DataFrame) -> DataFrame:
    """(fit, block, date, f, v, loglik): each factor's mean and variance given its block's values, and their log-density."""
    joined = rows.filter("y IS NOT NULL").join(parameters.select("fit", "series", "loading", "noise"), ["fit", "series"])
    sums = joined.groupBy("fit", "block", "date").agg(
        F.sum(F.col("loading") * F.col("loading") / F.col("noise")).alias("own"),
        F.sum(F.col("loading") * F.col("y") / F.col("noise")).alias("cross"),
        F.sum(F.col("y") * F.col("y") / F.col("noise") + F.log(2 * math.pi * F.col("noise"))).alias("fixed"),
    )
    v = 1 / (1 + F.col("own"))
    return sums.select("fit", "block", "date", (v * F.col("cross")).alias("f"), v.alias("v"), (-0.5 * (F.col("fixed") - F.log(v) - v * F.col("cross") * F.col("cross"))).alias("loglik"))


def fit_static(rows: DataFrame, start: DataFrame, tolerance: float = 1e-6, max_iter: int = 200) -> DataFrame:
    """(fit, series, loading, noise, loglik, iterations, converged) of every fit in start.

    rows: (fit, series, block, date, y); start: (fit, series, loading, noise). A fit
    has settled when its log-likelihood grows by less than tolerance of its size
    plus one. Its parameters are those that the log-likelihood belongs to. Fits
    without values keep their start and settle at once, with a log-likelihood of 0;
    a series without values has loading 0 and noise 1. Building the result runs a
    few jobs a round.
    """
    with scope(rows.sparkSession) as own:
        rows = materialise(rows.select("fit", "series", "block", "date", "y"), "em-rows")
        params = materialise(start.select("fit", "series", "loading", "noise"), "em-start")
        before = params.select("fit").distinct().withColumn("old", F.lit(None).cast("double"))
        done: list[DataFrame] = []
        for k in range(max_iter):
            moments = materialise(factor_moments(rows.join(before.select("fit"), "fit", "left_semi"), params), "em-moments")
            likelihood = before.join(moments.groupBy("fit").agg(F.sum("loglik").alias("loglik")), "fit", "left").withColumn("loglik", F.coalesce("loglik", F.lit(0.0)))
            settled = F.abs(F.col("loglik") - F.col("old")) < tolerance * (1 + F.abs("old"))
            settled = F.coalesce(settled, F.lit(False)) | (F.col("loglik") == 0)
            state = materialise(likelihood.withColumn("converged", settled), "em-state", open=F.count(F.when(~settled, 1)))
            last = not measured(state, "open") or k == max_iter - 1
            leaving = state if last else state.filter("converged")
            left = params.join(leaving.select("fit", "loglik", "converged"), "fit").withColumn("iterations", F.lit(k + 1))
            done.append(materialise(left.select("fit", "series", "loading", "noise", "loglik", "iterations", "converged"), "em-done"))
            if last:
                break
            going = state.filter("NOT converged")
            active = rows.join(going.select("fit"), "fit", "left_semi").join(moments.select("fit", "block", "date", "f", "v"), ["fit", "block", "date"])
            even = active.select("fit", "date").distinct().withColumn("w", F.lit(1.0))
            updated = updated_loadings(active, even).withColumn("noise", F.greatest(F.lit(LEAST_NOISE), F.col("noise")))
            kept = params.join(going.select("fit"), "fit", "left_semi")
            merged = kept.select("fit", "series").join(updated, ["fit", "series"], "left").select("fit", "series", F.coalesce("loading", F.lit(0.0)).alias("loading"), F.coalesce("noise", F.lit(1.0)).alias("noise"))
            older, params = params, materialise(merged, "em-parameters")
            before = materialise(going.select("fit", F.col("loglik").alias("old")), "em-before")
            discard(older, moments)
        result = done[0]
        for more in done[1:]:
            result = result.unionByName(more)
        return own.keep(materialise(result, "em-result", rows))
