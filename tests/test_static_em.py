"""The relational iteration against a plain loop."""

import datetime

import numpy as np
import pytest

from tidemark.operators import static_em


def plain(y, block, loading, noise, tolerance, max_iter):
    old = None
    for k in range(max_iter):
        f, v, total = np.zeros((len(y), 2)), np.ones((len(y), 2)), 0.0
        for t in range(len(y)):
            for b in range(2):
                s = np.flatnonzero((block == b) & np.isfinite(y[t]))
                if not len(s):
                    continue
                cov = np.outer(loading[s], loading[s]) + np.diag(noise[s])
                total += -0.5 * (len(s) * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + y[t, s] @ np.linalg.solve(cov, y[t, s]))
                v[t, b] = 1 / (1 + (loading[s] ** 2 / noise[s]).sum())
                f[t, b] = v[t, b] * (loading[s] * y[t, s] / noise[s]).sum()
        if old is not None and abs(total - old) < tolerance * (1 + abs(old)):
            return loading, noise, total, k + 1, True
        if k == max_iter - 1:
            return loading, noise, total, k + 1, False
        old, loading, noise = total, loading.copy(), noise.copy()
        for i in range(y.shape[1]):
            t = np.isfinite(y[:, i])
            a, second = f[t, block[i]], f[t, block[i]] ** 2 + v[t, block[i]]
            loading[i] = (y[t, i] * a).sum() / second.sum()
            noise[i] = max(1e-6, ((y[t, i] ** 2).sum() - 2 * loading[i] * (y[t, i] * a).sum() + loading[i] ** 2 * second.sum()) / t.sum())


def test_equals_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    block = np.array([0, 0, 0, 1, 1])
    panels = {}
    for fit, n in (("a", 60), ("b", 25)):
        f = rng.standard_normal((n, 2))
        y = f[:, block] * rng.uniform(0.5, 1.5, 5) + rng.standard_normal((n, 5)) * 0.5
        y[rng.random(y.shape) < 0.15] = np.nan
        panels[fit] = y
    day = datetime.date(2000, 1, 1)
    rows = [(fit, f"s{i}", f"b{block[i]}", day + datetime.timedelta(days=t), None if np.isnan(y[t, i]) else float(y[t, i])) for fit, y in panels.items() for t in range(len(y)) for i in range(5)]
    table = spark.createDataFrame(rows, "fit string, series string, block string, date date, y double")
    start = spark.createDataFrame([(fit, f"s{i}", 0.5, 0.8) for fit in [*panels, "empty"] for i in range(5)], "fit string, series string, loading double, noise double")
    made = static_em.fit_static(table, start, tolerance=8e-3, max_iter=9).collect()
    rounds = set()
    for fit, y in panels.items():
        loading, noise, total, k, converged = plain(y, block, np.full(5, 0.5), np.full(5, 0.8), 8e-3, 9)
        own = sorted((r for r in made if r.fit == fit), key=lambda r: r.series)
        assert np.allclose([r.loading for r in own], loading) and np.allclose([r.noise for r in own], noise)
        assert all(r.loglik == pytest.approx(total) and (r.iterations, r.converged) == (k, converged) for r in own)
        rounds.add(k)
    assert all(r.converged and r.iterations == 1 and r.loading == 0.5 for r in made if r.fit == "empty") and len(made) == 15
    assert len(rounds) == 2  # the fits left the iteration at different rounds
