"""The scans against a plain recursion, for blocks of all lengths."""

import datetime

import numpy as np
import pytest

from tidemark.operators import scalar_filter as S

DECAY, SHOCK, NOISE = 0.8, 0.3, 0.6


def plain(ys):
    m, p, states, loglik = 0.0, 1.0, [(0.0, 1.0)], []
    total = 0.0
    for y in ys:
        m, p = DECAY * m, DECAY**2 * p + SHOCK
        if y is not None:
            s = p + NOISE
            total += -0.5 * (np.log(2 * np.pi) + np.log(s) + (y - m) ** 2 / s)
            m, p = m + p / s * (y - m), p * NOISE / s
        states.append((m, p))
        loglik.append(total)
    smooth, lag = [states[-1]], []
    for m, p in reversed(states[:-1]):
        gain = DECAY * p / (DECAY**2 * p + SHOCK)
        lag.append(smooth[-1][1] * gain)
        smooth.append((m + gain * (smooth[-1][0] - DECAY * m), p + gain**2 * (smooth[-1][1] - DECAY**2 * p - SHOCK)))
    return states[1:], loglik, smooth[::-1][1:], lag[::-1]


@pytest.mark.parametrize("days", [1, 7, 1024])
def test_equals_a_plain_recursion(spark, days):
    rng = np.random.default_rng(1)
    series = {k: [None if rng.random() < 0.2 else float(x) for x in rng.standard_normal(n)] for k, n in (("a", 1), ("b", 2), ("c", 45), ("d", 64))}
    series["nothing"] = [None] * 5
    start = datetime.date(1999, 12, 1)
    rows = [(k, start + datetime.timedelta(days=2 * i), y, "x") for k, ys in series.items() for i, y in enumerate(ys)]
    table = spark.createDataFrame(rows, "key string, date date, y double, block string").repartition(5)
    filtered, smoothed = S.scalar_filter(table, DECAY, SHOCK, NOISE, days).collect(), S.scalar_smoother(table, DECAY, SHOCK, NOISE, days).collect()
    for k, ys in series.items():
        states, loglik, smooth, lag = plain(ys)
        own = sorted((r for r in filtered if r.key == k), key=lambda r: r.date)
        assert np.allclose([(r.mean, r.variance) for r in own], states) and np.allclose([r.loglik for r in own], loglik)
        own = sorted((r for r in smoothed if r.key == k), key=lambda r: r.date)
        assert np.allclose([(r.mean, r.variance) for r in own], smooth) and np.allclose([r.lag_one for r in own], lag)


def test_one_long_key_runs_over_several_tasks(spark):
    rows = spark.range(20_000).selectExpr("'k' AS key", "date_from_unix_date(cast(id as int)) AS date", "sin(id) AS y")
    made = S.scalar_smoother(rows, DECAY, SHOCK, NOISE, 500)
    assert made.count() == 20_000
    used = S._filtered(rows, DECAY, SHOCK, NOISE, 500)[0].selectExpr("spark_partition_id() AS p").distinct().count()
    assert used > 1
    assert S.scalar_filter(rows.limit(0), DECAY, SHOCK, NOISE).count() == 0
