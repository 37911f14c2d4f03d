"""ARMA nowcasts of many histories, each a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

ORDERS = ((2, 2), (1, 1), (1, 0))


def arma_forecast(x: np.ndarray, p: int, q: int, steps: int) -> float:
    """An ARMA(p, q) with constant, fitted in two least-squares stages, some steps ahead; ValueError if it can't be.

    A long autoregression gives innovations; the series is regressed on its own and
    the innovations' lags.
    """
    n, long = len(x), min(len(x) // 3, 2 * (p + q) + 2)
    if n < 3 * (p + q + 1) or long <= max(p, q):
        raise ValueError("too short")
    lagged = lambda v, k, start: np.column_stack([v[start - i : len(v) - i] for i in range(1, k + 1)]) if k else np.zeros((len(v) - start, 0))
    first = np.column_stack([np.ones(n - long), lagged(x, long, long)])
    shocks = np.r_[np.zeros(long), x[long:] - first @ np.linalg.lstsq(first, x[long:], rcond=None)[0]]
    start = long + q
    second = np.column_stack([np.ones(n - start), lagged(x, p, start), lagged(shocks, q, start)])
    beta = np.linalg.lstsq(second, x[start:], rcond=None)[0]
    ar = beta[1 : p + 1]
    if p and np.abs(np.roots(np.r_[1, -ar])).max() >= 1:
        raise ValueError("not stationary")
    past, noise = list(x), list(shocks)
    for _ in range(steps):
        past.append(float(beta[0] + sum(a * past[-i] for i, a in enumerate(ar, 1)) + sum(b * noise[-i] for i, b in enumerate(beta[p + 1 :], 1))))
        noise.append(0.0)
    if not np.isfinite(past[-1]):
        raise ValueError("not finite")
    return past[-1]


def _nowcast(key, rows):
    rows = rows.sort_values("date")
    x, steps = rows["value"].to_numpy(dtype=float), int(rows["steps"].iloc[0])
    level, used = float(x.mean()), "mean"
    if steps <= 0:
        level, used = float(x[-1]), "published"
    else:
        for p, q in ORDERS:
            try:
                level, used = arma_forecast(x, p, q, steps), f"arma{p}{q}"
                break
            except (ValueError, np.linalg.LinAlgError):
                continue
    std = x.std(ddof=1) if len(x) > 1 else np.nan
    return pd.DataFrame({"as_of": [key[0]], "target_quarter": [key[1]], "model": [used], "nowcast_level": [level], "nowcast_z": [(level - x.mean()) / std if std > 0 else np.nan]})


def arma_nowcasts(histories: DataFrame) -> DataFrame:
    """(as_of, target_quarter, model, nowcast_level, nowcast_z) from (as_of, target_quarter, steps, date, value).

    Orders are tried from the largest; the mean is the last resort. With no steps
    to go the target is published and is its own nowcast.
    """
    schema = "as_of date, target_quarter string, model string, nowcast_level double, nowcast_z double"
    return histories.groupBy("as_of", "target_quarter").applyInPandas(_nowcast, schema)
