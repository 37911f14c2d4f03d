"""Exact quantiles against a plain version, with ranges cut often and seldom."""

import math

import numpy as np
import pytest

from tidemark.operators import quantiles

LEVELS = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.777, "e": 1.0}


def groups():
    rng = np.random.default_rng(0)
    return {
        "normal": rng.standard_normal(997).tolist(),
        "ties": [1.0] * 400 + [2.0] * 300 + [3.0],
        "wide": [*(10.0 ** np.arange(-300, 300, 1.5)).tolist(), *(-(10.0 ** np.arange(-300, 300, 2.0))).tolist()],
        "near": (1e15 + np.arange(300)).tolist() + [1e300],
        "one": [7.5],
        "odd": [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 5e-324, 1e308, -1e308],
        None: [3.0, None, 1.0],
        "none": [None, math.nan],
    }


@pytest.mark.parametrize(("least", "bins"), [(50_000, 2048), (3, 16)])
def test_equals_a_plain_version(spark, monkeypatch, least, bins):
    monkeypatch.setattr(quantiles, "LEAST", least)
    monkeypatch.setattr(quantiles, "BINS", bins)
    data = groups()
    rows = spark.createDataFrame([(k, v, "x") for k, vs in data.items() for v in vs], "key string, value double, _v string").repartition(5).cache()
    got = {r.key: r for r in quantiles.exact_quantiles(rows, ["key"], "value", LEVELS).collect()}
    assert set(got) == set(data) - {"none"}
    for key, r in got.items():
        known = np.sort(np.clip([v for v in data[key] if v is not None and not math.isnan(v)], -1.7976931348623157e308, 1.7976931348623157e308))
        assert r.n == len(known)
        for name, p in LEVELS.items():
            place = p * (len(known) - 1)
            low, high = known[math.floor(place)], known[math.ceil(place)]
            want = low + (high - low) * (place - math.floor(place)) if math.isfinite(high - low) else None
            assert want is None or r[name] == pytest.approx(want, rel=1e-12, abs=1e-300)


def test_without_keys_and_without_rows(spark):
    rows = spark.range(1001).selectExpr("cast(id as double) AS value")
    assert [tuple(r) for r in quantiles.exact_quantiles(rows, [], "value", {"m": 0.5, "q": 0.1}).collect()] == [(1001, 500.0, 100.0)]
    assert quantiles.exact_quantiles(rows.limit(0), [], "value", {"m": 0.5}).count() == 0


def test_plans_hold_no_percentile(spark):
    from tidemark.plans import catalogue

    for name in ("replica_aggregate", "trend_pivot", "quantile_rearrange", "density_quantiles", "density_describe"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "percentile" not in plan
