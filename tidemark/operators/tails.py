"""Tail risk of grouped samples: quantile regression and simulated densities."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TAUS = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)


def quantile_fit(x: np.ndarray, y: np.ndarray, tau: float, rounds: int = 200) -> np.ndarray:
    """Coefficients of the tau-quantile of y on x, by iteratively reweighted least squares."""
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(rounds):
        error = y - x @ beta
        w = np.where(error < 0, 1 - tau, tau) / np.maximum(np.abs(error), 1e-6)
        new = np.linalg.solve((x * w[:, None]).T @ x + 1e-10 * np.eye(x.shape[1]), (x * w[:, None]).T @ y)
        if np.abs(new - beta).max() < 1e-9:
            return new
        beta = new
    return beta


def quantile_regressions(rows: DataFrame, predictors: list[str]) -> DataFrame:
    """(key, tau, name, beta) for each key of rows (key, y, predictors), with a constant; a group is one regression."""

    def run(key, frame):
        frame = frame.dropna()
        x = np.column_stack([np.ones(len(frame)), *[frame[p] for p in predictors]])
        if len(frame) <= x.shape[1]:
            return pd.DataFrame({"key": [], "tau": [], "name": [], "beta": []})
        found = [(key[0], tau, n, b) for tau in TAUS for n, b in zip(["const", *predictors], quantile_fit(x, frame["y"].to_numpy(), tau), strict=True)]
        return pd.DataFrame(found, columns=["key", "tau", "name", "beta"])

    return rows.select("key", "y", *predictors).groupBy("key").applyInPandas(run, "key string, tau double, name string, beta double")


def predicted_quantiles(betas: DataFrame, points: DataFrame, predictors: list[str]) -> DataFrame:
    """(key, tau, q) at points (key, predictors): a join and a sum, no fitting."""
    long = points.select("key", F.lit("const").alias("name"), F.lit(1.0).alias("x")).unionByName(points.unpivot(["key"], predictors, "name", "x"))
    return betas.join(long, ["key", "name"]).groupBy("key", "tau").agg(F.sum(F.col("beta") * F.col("x")).alias("q"))


def tail_summary(betas: DataFrame, name: str) -> DataFrame:
    """(key, b05, b10, b50, steepening): a predictor's slopes in the lower tail and the middle."""
    at = lambda t: F.max(F.when(F.col("tau") == t, F.col("beta")))
    rows = betas.filter(F.col("name") == name).groupBy("key").agg(at(0.05).alias("b05"), at(0.10).alias("b10"), at(0.50).alias("b50"))
    return rows.withColumn("steepening", F.col("b05") - F.col("b50"))


def density_draws(spark: SparkSession, parameters: DataFrame, draws: int, batches: int = 8, seed: int = 1) -> DataFrame:
    """(key, draw) of a scale-mixture density: mean + sd * normal / sqrt(gamma weight), for each key of (key, mean, sd, nu).

    Draws are dealt in batches with a seed each, so their number bounds no task.
    """

    def run(frames):
        for frame in frames:
            for row in frame.itertuples():
                rng = np.random.default_rng([seed, int(row.batch), zlib.crc32(str(row.key).encode())])
                n = draws // batches
                w = rng.gamma(row.nu / 2, 2 / row.nu, n) if np.isfinite(row.nu) else np.ones(n)
                yield pd.DataFrame({"key": row.key, "draw": row.mean + row.sd * rng.standard_normal(n) / np.sqrt(w)})

    each = parameters.select("key", "mean", "sd", "nu", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"))
    return each.repartition(batches, "key", "batch").mapInPandas(run, "key string, draw double")


def describe_draws(draws: DataFrame, realised: DataFrame) -> DataFrame:
    """Moments, quantiles and the probability at or below the realised value of each key's draws."""
    rows = draws.join(realised, "key", "left")
    q = lambda p: F.percentile_approx("draw", F.lit(p), F.lit(10_000))
    return rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.avg("draw").alias("mean"), F.stddev_pop("draw").alias("std"), F.skewness("draw").alias("skew"), F.kurtosis("draw").alias("exkurt"),
        q(0.05).alias("q05"), q(0.5).alias("median"), q(0.95).alias("q95"), F.avg((F.col("draw") <= F.col("realised")).cast("double")).alias("pit"),
    )
