"""Shares of draws below points, against a plain count."""

import math

import pytest

from tidemark.operators import recovery

NAN = math.nan
POINTS = [-9.0, 9.0, 0.5, 2.0, None, NAN, 0.0, 4.0, -0.3, 0.5]


def number(x):
    return x is not None and not math.isnan(x)


@pytest.mark.parametrize("draws", [[k / 7 - 3 for k in range(50)] + [0.5] * 200 + [None, NAN], [2.0] * 5, [None], []])
def test_share_below_counts_all_draws(spark, draws):
    points = spark.createDataFrame(list(enumerate(POINTS)), "i int, x double")
    got = recovery.share_below(points, "x", spark.createDataFrame([(d,) for d in draws], "y double"), "y", 7).collect()
    known = [d for d in draws if number(d)]
    share = lambda p: sum(d <= p for d in known) / len(known) if number(p) and known else None
    assert {r.i: r.pit for r in got} == {i: share(p) for i, p in enumerate(POINTS)} and len(got) == len(POINTS)


def test_order_tables_are_aggregated_once(spark):
    from tidemark.plans import base

    sf = "/root/testdata/sf0.001"
    assert base.standardised(spark, sf).sameSemantics(base.standardised(spark, sf))
    base.standardised(spark, sf).count()
    plan = base.factors(spark, sf)[0]._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().length() == 1 and plan.toString().startswith("InMemoryRelation")
