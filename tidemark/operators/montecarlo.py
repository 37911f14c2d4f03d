"""Recovery experiments: panels drawn from a known block factor model, refitted and scored.

A replication is a row of a grid; Spark deals the rows. Drawing a panel serves
nothing but this scoring, so it is one short function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.transforms import QUARTER_WEIGHTS
from .factor_model import LAGS, fit

METRICS = "estimator string, months int, pi double, seed long, n_iter int, converged boolean, loading_error double, factor_corr double, weight_corr double, detection double"
BLOCKS, PER_BLOCK, BURN = 3, 4, 100


def draw_panel(months: int, nu: float, pi: float, seed: int, kappa: float = 5.0, nu_outlier: float = 3.0):
    """(panel, loadings, factors, observation weights, contaminated dates); the last series is quarterly, its lags NaN at the start."""
    rng = np.random.default_rng(seed)
    weight = lambda n: rng.gamma(nu / 2, 2 / nu, n) if np.isfinite(nu) else np.ones(n)
    w_u, block = weight(months + BURN), np.arange(BLOCKS * PER_BLOCK) % BLOCKS
    shocks = rng.standard_normal((months + BURN, BLOCKS)) * 0.6 / np.sqrt(w_u)[:, None]
    f = np.zeros((months + BURN, BLOCKS))
    for t in range(1, len(f)):
        f[t] = 0.7 * f[t - 1] + shocks[t]
    f = f[BURN:]
    loading = rng.uniform(0.5, 1.5, len(block))
    w_eps = weight(months)
    noise = 0.5 * rng.standard_normal((months, len(block))) / np.sqrt(w_eps)[:, None]
    bad = rng.random(months) < pi
    noise[bad] = kappa * 0.5 * rng.standard_t(nu_outlier, (int(bad.sum()), len(block)))
    combined = f[:, block]
    five = np.full((months, BLOCKS), np.nan)
    five[LAGS - 1 :] = sum(w * f[LAGS - 1 - k : months - k] for k, w in enumerate(QUARTER_WEIGHTS))
    combined[:, -1] = five[:, block[-1]]
    y = combined * loading + noise
    y[np.arange(months) % 3 != 2, -1] = np.nan
    y[-2:, : BLOCKS] = np.nan
    return y, loading, f, w_eps, bad


def _replicate(max_iter: int):
    def run(frames):
        for frame in frames:
            for row in frame.itertuples():
                out = {"estimator": row.estimator, "months": row.months, "pi": row.pi, "seed": row.seed, "n_iter": -1, "converged": False}
                try:
                    y, loading, f, w_eps, bad = draw_panel(int(row.months), np.inf if row.pi > 0 else 5.0, row.pi, int(row.seed))
                    block = np.arange(len(loading)) % BLOCKS
                    quarterly = np.arange(len(loading)) == len(loading) - 1
                    found = fit(y, block, quarterly, BLOCKS, row.estimator == "student_t", max_iter)
                    # a block's scale and sign are free: fitted to the truth by least squares
                    h = np.array([found["loading"][block == b] @ loading[block == b] / (found["loading"][block == b] ** 2).sum() for b in range(BLOCKS)])
                    out |= {"n_iter": found["n_iter"], "converged": found["converged"]}
                    out["loading_error"] = float(np.linalg.norm(found["loading"] * h[block] - loading) / np.linalg.norm(loading))
                    out["factor_corr"] = float(np.mean([abs(np.corrcoef(found["means"][:, b], f[:, b])[0, 1]) for b in range(BLOCKS)]))
                    if np.ptp(found["w_eps"]) > 0 and row.pi == 0:
                        out["weight_corr"] = float(np.corrcoef(found["w_eps"], w_eps)[0, 1])
                    if np.ptp(found["w_eps"]) > 0 and bad.any():
                        least = np.argsort(found["w_eps"], kind="stable")[: bad.sum()]
                        out["detection"] = float(bad[least].mean())
                except (np.linalg.LinAlgError, ValueError):
                    pass
                yield pd.DataFrame([out]).reindex(columns=[c.split()[0] for c in METRICS.split(", ")])

    return run


def grid(spark: SparkSession, months: list[int], estimators: list[str], pis: list[float], replications: int, seed: int = 1000) -> DataFrame:
    """(estimator, months, pi, seed): every combination, with a seed for each replication."""
    lists = [F.array(*map(F.lit, x)) for x in (estimators, months, pis)]
    rows = spark.range(replications).select((F.col("id") + seed).alias("seed"))
    for name, values in zip(("estimator", "months", "pi"), lists, strict=True):
        rows = rows.withColumn(name, F.explode(values))
    return rows.select("estimator", F.col("months").cast("int").alias("months"), F.col("pi").cast("double").alias("pi"), "seed")


def replications(work: DataFrame, max_iter: int = 100, tasks: int | None = None) -> DataFrame:
    """METRICS for each row of a grid; rows that are done already are left out of `work` by an anti-join before."""
    n = tasks or work.sparkSession.sparkContext.defaultParallelism
    return work.repartition(n, "estimator", "months", "pi", "seed").mapInPandas(_replicate(max_iter), METRICS)


def long_metrics(done: DataFrame) -> DataFrame:
    """(scenario, metric, value) for recovery.replication_summary."""
    scenario = F.format_string("%s_T%04d_pi%.2f", "estimator", "months", "pi")
    return done.withColumn("scenario", scenario).unpivot(["scenario"], ["loading_error", "factor_corr", "weight_corr", "detection"], "metric", "value")
