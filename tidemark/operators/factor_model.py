"""Block factor models with missing values, fitted by EM; one fit is a group, Spark runs the groups.

Each series loads on its block's factor alone; factors follow a VAR(1). A quarterly
series loads on the factor's last five months with fixed weights, so the state
holds five months. With Student-t errors every date has a scale weight for its
factor shocks and one for its observation errors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import digamma
from ..functions.transforms import QUARTER_WEIGHTS

LAGS = len(QUARTER_WEIGHTS)
FIT = (
    "fit_id string, estimator string, n_iter int, converged boolean, loglik double, nu_u double, nu_eps double, series array<string>, "
    "loading array<double>, noise array<double>, transition array<array<double>>, shock array<array<double>>, "
    "dates array<date>, factors array<array<double>>, w_eps array<double>, w_u array<double>, target_z double"
)


def loading_rows(loading, block, quarterly, blocks: int) -> np.ndarray:
    """Loadings on the five-month state: a monthly series on its factor now, a quarterly one on all five months."""
    rows = np.zeros((len(loading), LAGS * blocks))
    for i, (x, b, q) in enumerate(zip(loading, block, quarterly, strict=True)):
        for lag in range(LAGS if q else 1):
            rows[i, lag * blocks + b] = x * (QUARTER_WEIGHTS[lag] if q else 1.0)
    return rows


def smooth(y, rows, transition, shock, noise, start, w_u, w_eps):
    """Smoothed state means and covariances of all dates, and the log-likelihood.

    The first prediction is from a zero state with covariance `start`. A date
    without observations carries its prediction on and adds nothing to the
    likelihood. The predicted covariance is singular, so the smoother uses its
    pseudo-inverse.
    """
    t_max, r = len(y), len(transition)
    k = LAGS * r
    step = np.zeros((k, k))
    step[:r, :r] = transition
    step[r:, :-r] = np.eye(k - r)
    mean, cov, loglik = np.zeros(k), start, 0.0
    predicted, filtered = [], []
    for t in range(t_max):
        mean, cov = step @ mean, step @ cov @ step.T
        cov[:r, :r] += shock / w_u[t]
        predicted.append((mean, cov))
        seen = ~np.isnan(y[t])
        if seen.any():
            z = rows[seen]
            s = z @ cov @ z.T + np.diag(noise[seen] / w_eps[t])
            error = y[t, seen] - z @ mean
            gain = np.linalg.solve(s, z @ cov).T
            loglik -= 0.5 * (seen.sum() * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + error @ np.linalg.solve(s, error))
            mean, cov = mean + gain @ error, cov - gain @ z @ cov
            cov = (cov + cov.T) / 2
        filtered.append((mean, cov))
    means, covs = np.empty((t_max, k)), np.empty((t_max, k, k))
    means[-1], covs[-1] = filtered[-1]
    inverses = np.linalg.pinv(np.array([c for _, c in predicted]), hermitian=True)
    for t in range(t_max - 2, -1, -1):
        back = filtered[t][1] @ step.T @ inverses[t + 1]
        means[t] = filtered[t][0] + back @ (means[t + 1] - predicted[t + 1][0])
        cov = filtered[t][1] + back @ (covs[t + 1] - predicted[t + 1][1]) @ back.T
        covs[t] = (cov + cov.T) / 2
    return means, covs, loglik


def _first_guess(y, block, quarterly, blocks: int):
    """Loadings, transition, shocks and noise from each block's first principal component, gaps filled with noise."""
    filled = np.where(np.isnan(y), np.random.default_rng(42).standard_normal(y.shape), y)
    factors = np.zeros((len(y), blocks))
    for b in range(blocks):
        own = filled[:, (block == b) & ~quarterly]
        v = np.linalg.eigh(own.T @ own / len(y))[1][:, -1] if own.shape[1] else np.zeros(0)
        factors[:, b] = own @ (v if v.sum() >= 0 else -v)
    f = factors[:, block]
    loading = (filled * f).sum(0) / np.maximum((f * f).sum(0), 1e-12)
    transition = np.linalg.lstsq(factors[:-1], factors[1:], rcond=None)[0].T
    error = factors[1:] - factors[:-1] @ transition.T
    noise = np.maximum((filled - f * loading).var(axis=0, ddof=1), 1e-3)
    return loading, transition, error.T @ error / (len(y) - 1) + 1e-6 * np.eye(blocks), noise


def _degrees(weights, logs) -> float:
    """Degrees of freedom by bisection of the first-order condition within (2.001, 1000)."""
    gap = logs.mean() - weights.mean() + 1
    low, high = 2.001, 1000.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.log(mid / 2) - digamma(mid / 2)[0] + gap > 0 else (low, mid)
    return (low + high) / 2


def fit(y, block, quarterly, blocks: int, student: bool, max_iter: int = 100, tol: float = 1e-4, inner: int = 2) -> dict:
    """EM until the likelihood's relative change is below tol. The first state covariance stays fixed."""
    t_max, m = y.shape
    loading, transition, shock, noise = _first_guess(y, block, quarterly, blocks)
    start, nu_u, nu_eps = np.eye(LAGS * blocks), 10.0, 10.0
    w_u, w_eps = np.ones(t_max), np.ones(t_max)
    seen = ~np.isnan(y)
    zero, before, converged, iteration = np.where(seen, y, 0.0), None, False, 0
    weight = np.zeros((m, LAGS))
    weight[~quarterly, 0] = 1
    weight[quarterly] = QUARTER_WEIGHTS
    lag_at = np.arange(LAGS)[None, :] * blocks + block[:, None]  # where a series' factor is in the state
    for iteration in range(1, max_iter + 1):
        rows = loading_rows(loading, block, quarterly, blocks)
        for _ in range(inner if student else 1):
            means, covs, loglik = smooth(y, rows, transition, shock, noise, start, w_u, w_eps)
            # the series' own combination of factors: mean g and variance v at every date
            g = np.einsum("ml,tml->tm", weight, means[:, lag_at])
            v = np.einsum("ml,tmlk,mk->tm", weight, covs[:, lag_at[:, :, None], lag_at[:, None, :]], weight)
            if student:
                d_eps = (seen * ((zero - g * loading) ** 2 + loading**2 * v) / noise).sum(1)
                now, past = means[:, :blocks], means[:, blocks : 2 * blocks]
                u = now - past @ transition.T
                c = covs[:, : 2 * blocks, : 2 * blocks]
                lead = np.hstack([np.eye(blocks), -transition])
                spread = np.einsum("ij,tjk,lk->til", lead, c, lead)
                inverse = np.linalg.inv(shock)
                d_u = np.einsum("ti,ij,tj->t", u, inverse, u) + np.einsum("ij,tji->t", inverse, spread)
                count = seen.sum(1)
                w_eps, w_u = (nu_eps + count) / (nu_eps + d_eps), (nu_u + blocks) / (nu_u + d_u)
                log_eps = digamma((nu_eps + count) / 2) - np.log((nu_eps + d_eps) / 2)
                log_u = digamma(np.full(t_max, (nu_u + blocks) / 2)) - np.log((nu_u + d_u) / 2)
                w_u[0], log_u[0] = 1.0, digamma(nu_u / 2)[0] - np.log(nu_u / 2)
        if before is not None and abs(loglik - before) <= tol * abs(before):
            converged = True
            break
        before = loglik
        w = seen * w_eps[:, None]
        loading = (w * zero * g).sum(0) / np.maximum((w * (g * g + v)).sum(0), 1e-12)
        noise = (w * ((zero - loading * g) ** 2 + loading**2 * v)).sum(0) / np.maximum(seen.sum(0), 1)
        noise = np.where(seen.any(0), np.maximum(noise, 1e-8), 1.0)
        second = covs[1:] + means[1:, :, None] * means[1:, None, :]
        moment = (w_u[1:, None, None] * second).sum(0)
        p11, p10, p00 = moment[:blocks, :blocks], moment[:blocks, blocks : 2 * blocks], moment[blocks : 2 * blocks, blocks : 2 * blocks]
        transition = np.linalg.solve(p00.T, p10.T).T
        shock = (p11 - transition @ p10.T) / (t_max - 1)
        shock = (shock + shock.T) / 2
        if student:
            nu_eps, nu_u = _degrees(w_eps, log_eps), _degrees(w_u, log_u)
    return {
        "n_iter": iteration, "converged": converged, "loglik": loglik, "nu_u": nu_u if student else np.inf, "nu_eps": nu_eps if student else np.inf,
        "loading": loading, "noise": noise, "transition": transition, "shock": shock, "means": means, "covs": covs, "w_eps": w_eps, "w_u": w_u, "combined": g,
    }


def normalised(found: dict, block, reference, blocks: int) -> dict:
    """Each factor with unit total variance and a non-negative loading of its reference series; fits don't change."""
    f, p = found["means"][:, :blocks], found["covs"][:, np.arange(blocks), np.arange(blocks)]
    scale = np.sqrt(np.maximum(f.var(axis=0) + p.mean(axis=0), 1e-12))
    sign = np.array([1.0 if found["loading"][reference[b]] >= 0 else -1.0 for b in range(blocks)])
    h = scale * sign
    return found | {
        "loading": found["loading"] * h[block],
        "transition": found["transition"] * h[None, :] / h[:, None],
        "shock": found["shock"] / (h[:, None] * h[None, :]),
        "factors": f / h,
        "h": h,
    }


def _fit_group(max_iter: int, tol: float):
    def run(key, rows):
        names = rows.drop_duplicates("series").sort_values("ord")
        wide = rows.pivot(index="date", columns="series", values="z").sort_index()[names["series"]]
        block = pd.Categorical(names["block"], categories=list(dict.fromkeys(names["block"]))).codes.astype(int)
        quarterly = (names["freq"] == "quarterly").to_numpy()
        blocks = block.max() + 1
        reference = [int(np.flatnonzero((block == b) & ~quarterly)[0]) for b in range(blocks)]
        row = {c.split()[0]: None for c in FIT.split(", ")} | {"fit_id": key[0], "estimator": key[1], "n_iter": -1, "converged": False}
        try:
            found = normalised(fit(wide.to_numpy(dtype=float), block, quarterly, blocks, key[1] == "student_t", max_iter, tol), block, reference, blocks)
            row |= {k: found[k] for k in ("n_iter", "converged", "loglik", "nu_u", "nu_eps", "loading", "noise", "w_eps", "w_u")}
            row |= {"series": list(names["series"]), "dates": list(wide.index), "transition": list(found["transition"]), "shock": list(found["shock"]), "factors": list(found["factors"])}
            if quarterly.any():
                q = int(np.flatnonzero(quarterly)[0])
                row["target_z"] = _target(found, q, block, blocks)
        except (np.linalg.LinAlgError, ValueError):  # a fit that breaks down is a result, with n_iter -1
            pass
        return pd.DataFrame([row])

    return run


def _target(found: dict, q: int, block, blocks: int) -> float:
    """The quarterly series' fitted value at the last date, from the five months' normalised factors."""
    months = found["means"][-1, block[q] :: blocks][:LAGS] / found["h"][block[q]]
    return float(found["loading"][q] * (np.array(QUARTER_WEIGHTS) @ months))


def fit_models(panels: DataFrame, estimators: tuple[str, ...] = ("student_t",), max_iter: int = 100, tol: float = 1e-4, tasks: int | None = None) -> DataFrame:
    """One fit for each fit_id of panels (fit_id, series, block, freq, ord, date, z) and estimator, a row of arrays as in FIT.

    Fits are groups of one panel's rows, bounded by its months and series. They are
    dealt to a stated number of tasks, so that small groups aren't put into one.
    n_iter is -1 for a fit that broke down.
    """
    each = F.explode(F.array(*map(F.lit, estimators)))
    rows = panels.select("fit_id", "series", "block", "freq", "ord", "date", "z", each.alias("estimator"))
    n = tasks or 4 * panels.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n, "fit_id", "estimator").groupBy("fit_id", "estimator").applyInPandas(_fit_group(max_iter, tol), FIT)


def nowcasts(panels: DataFrame, estimators: tuple[str, ...], max_iter: int = 100) -> DataFrame:
    """(fit_id, method, nowcast_z, nowcast_level, n_iter, converged): the quarterly series at each panel's last date.

    panels also holds the series' mean and std, those of the panel itself, by which
    the level is put back on its scale.
    """
    scale = panels.filter("freq = 'quarterly'").groupBy("fit_id").agg(F.max("mean").alias("mean"), F.max("std").alias("std"))
    made = fit_models(panels, estimators, max_iter).select("fit_id", "estimator", "target_z", "n_iter", "converged")
    level = F.col("target_z") * F.col("std") + F.col("mean")
    return made.join(scale, "fit_id", "left").select(
        "fit_id", F.col("estimator").alias("method"), F.col("target_z").alias("nowcast_z"), level.alias("nowcast_level"), "n_iter", "converged"
    )
