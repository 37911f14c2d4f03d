"""Skewed t densities on grids against plain integration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import densities


def test_t_distribution(spark):
    # closed forms for one, two and four degrees of freedom
    exact = {1.0: lambda x: 0.5 + math.atan(x) / math.pi, 2.0: lambda x: 0.5 + x / (2 * math.sqrt(2 + x * x)), 4.0: lambda x: 0.5 + 0.375 * (x / math.sqrt(1 + x * x / 4)) * (1 - x * x / (12 * (1 + x * x / 4)))}
    rows = [(x, nu) for nu in exact for x in (-8.0, -1.0, 0.0, 0.3, 2.5, 40.0)]
    for r in spark.createDataFrame(rows, "x double, nu double").withColumn("p", densities.t_distribution(F.col("x"), F.col("nu"))).collect():
        assert r.p == pytest.approx(exact[r.nu](r.x), abs=1e-8)


def test_grid_quantiles_and_probabilities(spark):
    schema = "key string, xi double, omega double, alpha double, nu double, low double, high double"
    rows = [("even", 1.0, 2.0, 0.0, 5.0, -29.0, 31.0), ("left", 0.0, 1.0, -4.0, 8.0, -30.0, 30.0), ("flat", 0.0, 0.0, 0.0, 5.0, -1.0, 1.0), ("none", None, 1.0, 0.0, 5.0, 0.0, 1.0)]
    grid = densities.skewed_grid(spark.createDataFrame(rows, schema), 3001)
    got = {(r.key, r.tau): r.q for r in densities.quantiles_of(grid, [0.0, 0.05, 0.5, 0.95, 1.0]).collect()}
    assert {k for k, _ in got} == {"even", "left"} and got["even", 0.5] == pytest.approx(1.0, abs=1e-6)
    assert got["even", 0.05] - 1 == pytest.approx(1 - got["even", 0.95], abs=1e-6) and got["even", 1.0] == 31.0 and got["even", 0.0] == -29.0
    assert (got["even", 0.95] - 1) / 2 == pytest.approx(2.015, abs=2e-2)  # the t table's value, on a cut range
    assert got["left", 0.5] < -0.4 and got["left", 0.95] < 0.5
    values = spark.createDataFrame([("even", 1.0, 1), ("even", -99.0, 2), ("even", 99.0, 3), ("left", got["left", 0.05], 4), ("even", None, 5), ("none", 1.0, 6)], "key string, value double, n int")
    pit = {r.n: r.pit for r in densities.probabilities_of(grid, values).collect()}
    assert pit[1] == pytest.approx(0.5, abs=1e-6) and pit[2] == 0.0 and pit[3] == 1.0 and pit[4] == pytest.approx(0.05, abs=1e-9) and pit[5] is None and pit[6] is None
    x = np.linspace(-30, 30, 3001)
    own = sorted((r.i, r.cdf) for r in grid.filter("key = 'left'").collect())
    assert np.all(np.diff([c for _, c in own]) >= 0) and own[-1][1] == pytest.approx(1.0) and len(own) == len(x)
