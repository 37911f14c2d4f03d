"""Queries over nowcast facts, weights, replications and quantiles."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..operators import accuracy as A
from ..operators import profile, recovery, rolling
from ..operators.quantiles import exact_quantiles
from ..sources.facts import KEY, pending
from ..sources.levels import quarterly_target, table
from . import base
from .base import END, START, r, sql

_PERIODS = ["1996-06_1998-12", "1999-01_2001-07"]


def random_walk_nowcast(spark: SparkSession, sf: str):
    rows = base.facts(spark, sf).filter("method = 'random_walk'")
    return rows.select("as_of", "target_quarter", "horizon", "nowcast_level", "nowcast_z", "realised", "error")


def rolling_facts(spark: SparkSession, sf: str):
    return base.facts(spark, sf).select("as_of", "target_quarter", "horizon", "method", "nowcast_level", "nowcast_z", "realised", "error", "period")


def accuracy_by_method_horizon(spark: SparkSession, sf: str):
    return A.by_method_horizon(base.facts(spark, sf))


def accuracy_by_method(spark: SparkSession, sf: str):
    return A.by_method(base.facts(spark, sf)).withColumn("rank", A.method_rank(F.col("method")).cast("int"))


def accuracy_by_period_pivot(spark: SparkSession, sf: str):
    made = A.by_period(base.facts(spark, sf), _PERIODS)
    return made.select("method", *[F.col(f"`{p}`").alias(f"rmse_{i}") for i, p in enumerate(_PERIODS)])


def accuracy_grouping_sets(spark: SparkSession, sf: str):
    return A.cube(base.facts(spark, sf)).select("method", "horizon", "period", "n", "rmse")


def relative_rmse(spark: SparkSession, sf: str):
    return A.by_method_horizon(base.facts(spark, sf), "mean").select("method", "horizon", "rmse_relative")


def extreme_quarters(spark: SparkSession, sf: str):
    return A.extremes(base.facts(spark, sf))


def realised_z_recover(spark: SparkSession, sf: str):
    return A.realised_z(base.facts(spark, sf)).select("as_of", "n", "slope", "intercept")


def trajectories(spark: SparkSession, sf: str):
    return A.trajectories(base.facts(spark, sf), 2).select("target_quarter", "method", "as_of", "horizon", "nth", "points", "nowcast_level")


def resume_antijoin(spark: SparkSession, sf: str):
    work = base.facts(spark, sf).select(*KEY, "horizon")
    return pending(work, work.filter("year(as_of) < 1999 OR method = 'mean'"))


def rank_overlap(spark: SparkSession, sf: str):
    return recovery.bottom_overlap(base.weights(spark, sf)).select("key", F.col("t_eff").cast("long").alias("t_eff"), F.col("k").cast("long").alias("k"), "overlap", "expected", "lift", "spearman")


def detection_at_k(spark: SparkSession, sf: str):
    return recovery.detection(base.weights(spark, sf))


def procrustes_block(spark: SparkSession, sf: str):
    z, factors = base.factors(spark, sf)
    early = profile.loadings(z.filter("date < date'1999-01-01'"), factors).select("series", F.col("loading").alias("hat"))
    rows = profile.loadings(z, factors).select("series", "block", F.col("loading").alias("star")).join(early, "series")
    return recovery.block_rotation(rows)


def _replications(spark: SparkSession, sf: str):
    """Order values by priority stand in for replications of two metrics."""
    rows = table(spark, sf, "orders").select(F.substring("o_orderpriority", 1, 1).alias("scenario"), F.col("o_totalprice").alias("rho_hat"), (F.col("o_totalprice") / 1000).alias("err_norm"))
    return rows.unpivot(["scenario"], ["rho_hat", "err_norm"], "metric", "value")


def replica_aggregate(spark: SparkSession, sf: str):
    truths = spark.createDataFrame([("rho_hat", 150000.0)], "metric string, truth double")
    made = recovery.replication_summary(_replications(spark, sf), truths)
    return made.select("scenario", "metric", "n", *[F.round(c, 3).alias(c) for c in ("mean", "std", "median", "q05", "q95", "bias", "rmse")])


def trend_pivot(spark: SparkSession, sf: str):
    truths = spark.createDataFrame([("rho_hat", 150000.0)], "metric string, truth double")
    made = recovery.trend(recovery.replication_summary(_replications(spark, sf), truths), ["1", "5"])
    return made.select("metric", F.round("1", 3).alias("first"), F.round("5", 3).alias("last"), "verdict")


def _quantiles(spark: SparkSession, sf: str):
    """Per discount, quantiles of the line price at three taus; the middle one is moved so that some cross."""
    lines = table(spark, sf, "lineitem").select(F.col("l_discount").cast("string").alias("key"), "l_extendedprice")
    rows = exact_quantiles(lines, ["key"], "l_extendedprice", {"a": 0.1, "b": 0.5, "c": 0.9})
    moved = F.when(F.col("n") % 2 == 0, F.col("b") * 3).otherwise(F.col("b"))
    taus = F.array(*[F.struct(F.lit(t).alias("tau"), q.alias("q")) for t, q in ((0.1, F.col("a")), (0.5, moved), (0.9, F.col("c")))])
    return rows.select("key", F.explode(taus).alias("t")).select("key", "t.tau", "t.q")


def quantile_rearrange(spark: SparkSession, sf: str):
    return recovery.rearranged(_quantiles(spark, sf)).select("key", "tau", F.round("q", 3).alias("q"), "crossed")


def check_loss(spark: SparkSession, sf: str):
    z = base.standardised(spark, sf).filter("freq = 'monthly' AND z IS NOT NULL")
    taus = F.explode(F.array(*[F.lit(t) for t in (0.1, 0.5, 0.9)])).alias("tau")
    shift = (F.col("tau") - 0.5) * 2
    rows = z.select(F.col("z").alias("y"), (F.col("ord") - 3.5).alias("c0"), taus).select("y", "tau", (shift + F.col("c0") / 100).alias("q"), shift.alias("c"))
    return recovery.check_loss(rows)


def pit_verdict(spark: SparkSession, sf: str):
    facts = base.facts(spark, sf).filter("realised IS NOT NULL AND method = 'mean'").select("target_quarter", "as_of", "realised")
    draws = base.facts(spark, sf).filter("method = 'random_walk'").select("nowcast_level")
    below = recovery.share_below(facts, "realised", draws, "nowcast_level")
    return below.select("target_quarter", "as_of", "pit", recovery.pit_verdict(F.col("pit")).alias("verdict"))


def density_describe(spark: SparkSession, sf: str):
    events = table(spark, sf, "events")
    moments = events.groupBy("event_type").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("exkurt"), F.avg((F.col("value") <= 50).cast("double")).alias("pit")
    )
    return moments.join(exact_quantiles(events, ["event_type"], "value", {"q05": 0.05, "q95": 0.95}), "event_type")


def vol_lags(spark: SparkSession, sf: str):
    """Log-size of order value surprises by quarter, with three-month means and the quarter before."""
    z = base.standardised(spark, sf).filter("series = 'order_value' AND z IS NOT NULL")
    w = Window.orderBy("date")
    logs = F.log(1 + F.col("z") * F.col("z"))
    rows = z.select("date", logs.alias("vol")).select("date", "vol", F.avg("vol").over(w.rowsBetween(-2, 0)).alias("mean3"), F.avg("vol").over(w.rowsBetween(-5, -3)).alias("mean3_before"), F.lag("vol").over(w).alias("vol_before"))
    return rows.filter(F.month("date").isin(3, 6, 9, 12))


def ols_simple(spark: SparkSession, sf: str):
    rows = vol_lags(spark, sf).filter("mean3_before IS NOT NULL")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("mean3", "mean3_before").alias("slope"), F.regr_intercept("mean3", "mean3_before").alias("intercept"), F.regr_r2("mean3", "mean3_before").alias("r2"))


QUERIES = {
    f.__name__: f
    for f in (
        random_walk_nowcast, rolling_facts, accuracy_by_method_horizon, accuracy_by_method, accuracy_by_period_pivot, accuracy_grouping_sets, relative_rmse, extreme_quarters,
        realised_z_recover, trajectories, resume_antijoin, rank_overlap, detection_at_k, procrustes_block, replica_aggregate, trend_pivot, quantile_rearrange, check_loss,
        pit_verdict, density_describe, vol_lags, ols_simple,
    )
}

_CORR = "CASE WHEN count(*) >= 2 AND stddev_pop(nowcast_level) > 0 AND stddev_pop(realised) > 0 THEN corr(nowcast_level, realised) END"
_SCORES = f"count(error) AS n, {r('sqrt(avg(error * error))', 'rmse')}, {r('avg(abs(error))', 'mae')}, {r('avg(error)', 'bias')}, {r(_CORR, 'corr')}, {r('avg(nowcast_z)', 'mean_z')}, {r('avg(abs(nowcast_z))', 'mean_abs_z')}"
_BY = "byh AS (SELECT method, horizon, sqrt(avg(error * error)) AS e FROM scored GROUP BY ALL)"


def _relative(benchmark: str) -> str:
    return f"rel AS (SELECT method, horizon, e / nullif(max(CASE WHEN method = '{benchmark}' THEN e END) OVER (PARTITION BY horizon), 0) AS x FROM byh)"


def _loadings(where: str) -> str:
    return f"(SELECT series, block, sum(z * factor) / sum(factor * factor) AS l FROM joined WHERE {where} GROUP BY ALL)"


_REPLICAS = """
rep AS (SELECT left(o_orderpriority, 1) AS scenario, 'rho_hat' AS metric, o_totalprice AS value, 150000.0::DOUBLE AS truth FROM orders
  UNION ALL SELECT left(o_orderpriority, 1), 'err_norm', o_totalprice / 1000, NULL FROM orders)"""
_Q = """
qs AS (SELECT CAST(l_discount AS VARCHAR) AS key, count(*) AS n, quantile_cont(l_extendedprice, 0.1) AS a, quantile_cont(l_extendedprice, 0.5) AS b, quantile_cont(l_extendedprice, 0.9) AS c FROM lineitem GROUP BY 1),
qm AS (SELECT key, a, CASE WHEN n % 2 = 0 THEN b * 3 ELSE b END AS b, c FROM qs)"""


def _3(x: str, name: str) -> str:
    return f"round(round(CAST({x} AS DOUBLE), 3), 6) AS {name}"


_VOL = """
vols AS (SELECT date, ln(1 + z * z) AS vol FROM zpanel WHERE series = 'order_value' AND z IS NOT NULL),
vlag AS (SELECT * FROM (SELECT date, vol, avg(vol) OVER (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean3, avg(vol) OVER (ORDER BY date ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS mean3_before,
  lag(vol) OVER (ORDER BY date) AS vol_before FROM vols) WHERE month(date) % 3 = 0)"""

_FACT = f"{r('nowcast_level', 'nowcast_level')}, {r('nowcast_z', 'nowcast_z')}, {r('realised', 'realised')}, {r('error', 'error')}"

SQL = {
    "random_walk_nowcast": sql("facts", f"SELECT as_of, target_quarter, horizon, {_FACT} FROM facts WHERE method = 'random_walk'"),
    "rolling_facts": sql("facts", f"SELECT as_of, target_quarter, horizon, method, period, {_FACT} FROM facts"),
    "accuracy_by_method_horizon": sql("facts", f"SELECT s.*, {r('x', 'rmse_relative')} FROM (SELECT method, horizon, {_SCORES} FROM scored GROUP BY ALL) s JOIN rel USING (method, horizon)", _BY, _relative("random_walk")),
    "accuracy_by_method": sql("facts", f"SELECT method, {_SCORES}, CAST(CASE method WHEN 'random_walk' THEN 4 WHEN 'mean' THEN 5 WHEN 'seasonal' THEN 6 END AS INTEGER) AS rank FROM scored GROUP BY ALL"),
    "accuracy_by_period_pivot": sql("facts", "SELECT method, " + ", ".join(r(f"sqrt(avg(error * error) FILTER (WHERE period = '{p}'))", f"rmse_{i}") for i, p in enumerate(_PERIODS)) + " FROM scored GROUP BY method"),
    "accuracy_grouping_sets": sql("facts", f"SELECT method, horizon, period, count(error) AS n, {r('sqrt(avg(error * error))', 'rmse')} FROM scored GROUP BY GROUPING SETS ((method, horizon), (method), (method, period))"),
    "relative_rmse": sql("facts", f"SELECT method, horizon, {r('x', 'rmse_relative')} FROM rel", _BY, _relative("mean")),
    "extreme_quarters": sql(
        "facts",
        f"SELECT target_quarter, horizon, method, {_FACT} FROM (SELECT *, rank() OVER (PARTITION BY target_quarter ORDER BY horizon DESC) AS k FROM scored WHERE target_quarter IN (SELECT target_quarter FROM scored GROUP BY 1 ORDER BY max(abs(realised)) DESC, 1 LIMIT 4)) WHERE k = 1",
    ),
    "realised_z_recover": sql(
        "facts",
        f"SELECT as_of, n, {r('slope', 'slope')}, {r('intercept', 'intercept')} FROM (SELECT as_of, count(*) AS n, regr_slope(nowcast_level, nowcast_z) AS slope, regr_intercept(nowcast_level, nowcast_z) AS intercept FROM facts WHERE nowcast_z IS NOT NULL GROUP BY as_of) WHERE n >= 2 AND slope IS NOT NULL AND abs(slope) > 1e-12",
    ),
    "trajectories": sql(
        "facts",
        f"SELECT target_quarter, method, as_of, horizon, CAST(nth AS INTEGER) AS nth, points, {r('nowcast_level', 'nowcast_level')} FROM (SELECT *, row_number() OVER (PARTITION BY target_quarter, method ORDER BY as_of) AS nth, count(*) OVER (PARTITION BY target_quarter, method) AS points FROM facts WHERE horizon >= 2) WHERE points >= 2",
    ),
    "resume_antijoin": sql("facts", "SELECT as_of, target_quarter, method, horizon FROM facts WHERE NOT (year(as_of) < 1999 OR method = 'mean')"),
    "rank_overlap": sql(
        "weights",
        f"SELECT key, t_eff, k, {r('hit / k', 'overlap')}, {r('k / t_eff', 'expected')}, {r('hit / k / (k / t_eff)', 'lift')}, {r('c', 'spearman')} FROM (SELECT key, t_eff, CAST(k AS BIGINT) AS k, count(*) FILTER (WHERE rh <= k) AS hit, corr(a_true, a_hat) AS c FROM avgr GROUP BY ALL)",
        "ranked AS (SELECT *, count(*) OVER (PARTITION BY key) AS t_eff, row_number() OVER (PARTITION BY key ORDER BY w_true, date) AS rt, row_number() OVER (PARTITION BY key ORDER BY w_hat, date) AS rh FROM late)",
        "topk AS (SELECT * FROM (SELECT *, greatest(1, round_even(t_eff * 0.1, 0)) AS k FROM ranked) WHERE rt <= k)",
        "avgr AS (SELECT *, rank() OVER (PARTITION BY key ORDER BY w_true) + (count(*) OVER (PARTITION BY key, w_true) - 1) / 2 AS a_true, rank() OVER (PARTITION BY key ORDER BY w_hat) + (count(*) OVER (PARTITION BY key, w_hat) - 1) / 2 AS a_hat FROM topk)",
    ),
    "detection_at_k": sql(
        "weights",
        f"SELECT key, tag, k, m AS n_contaminated, {r('hits / m', 'recall')}, {r('hits / k', 'precision')}, {r('hits / m / (k / t)', 'lift')} FROM (SELECT key, tag, k, m, t, count(*) FILTER (WHERE contaminated AND rk <= k) AS hits FROM tagged GROUP BY ALL)",
        "ranked AS (SELECT *, count(*) OVER (PARTITION BY key) AS t, CAST(sum(CAST(contaminated AS INTEGER)) OVER (PARTITION BY key) AS BIGINT) AS m, max(w_hat) OVER (PARTITION BY key) - min(w_hat) OVER (PARTITION BY key) AS span, row_number() OVER (PARTITION BY key ORDER BY w_hat, date) AS rk FROM late)",
        "tagged AS (SELECT *, 'natural' AS tag, m AS k FROM ranked WHERE m > 0 AND span > 0 UNION ALL SELECT *, '5pct', CAST(greatest(1, round_even(t * 0.05, 0)) AS BIGINT) FROM ranked WHERE m > 0 AND span > 0 UNION ALL SELECT *, '10pct', CAST(greatest(1, round_even(t * 0.10, 0)) AS BIGINT) FROM ranked WHERE m > 0 AND span > 0)",
    ),
    "procrustes_block": sql(
        "factors",
        f"SELECT block, {r('h', 'h')}, {r('sign(h)', 'sign')}, {r('sqrt(sum((hat * h - star) ** 2)) / sqrt(sum(star ** 2))', 'error')} FROM (SELECT *, sum(hat * star) OVER (PARTITION BY block) / sum(hat * hat) OVER (PARTITION BY block) AS h FROM (SELECT a.block, a.series, a.l AS star, b.l AS hat FROM {_loadings('true')} a JOIN {_loadings('date < DATE ' + chr(39) + '1999-01-01' + chr(39))} b ON a.series = b.series)) GROUP BY block, h",
    ),
    "replica_aggregate": "WITH "
    + _REPLICAS
    + f" SELECT scenario, metric, count(*) AS n, {_3('avg(value)', 'mean')}, {_3('stddev_samp(value)', 'std')}, {_3('quantile_cont(value, 0.5)', 'median')}, {_3('quantile_cont(value, 0.05)', 'q05')}, {_3('quantile_cont(value, 0.95)', 'q95')}, {_3('avg(value - truth)', 'bias')}, {_3('sqrt(avg((value - coalesce(truth, 0)) ** 2))', 'rmse')} FROM rep GROUP BY ALL",
    "trend_pivot": "WITH "
    + _REPLICAS
    + f" SELECT metric, {_3('a', 'first')}, {_3('b', 'last')}, CASE WHEN b > a THEN 'GROWS' WHEN b < a THEN 'FALLS' ELSE 'FLAT' END AS verdict FROM (SELECT metric, avg(value) FILTER (WHERE scenario = '1') AS a, avg(value) FILTER (WHERE scenario = '5') AS b FROM rep GROUP BY metric)",
    "quantile_rearrange": "WITH "
    + _Q
    + f" SELECT key, tau, {_3('q', 'q')}, b < a OR c < b AS crossed FROM (SELECT key, a, b, c, unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS tau, unnest(list_sort([a, b, c])) AS q FROM qm)",
    "check_loss": sql(
        "z",
        f"SELECT tau, count(*) AS n, {r('sum((y - q) * (tau - CAST(y < q AS DOUBLE)))', 'loss')}, {r('sum((y - c) * (tau - CAST(y < c AS DOUBLE)))', 'loss_constant')}, {r('1 - sum((y - q) * (tau - CAST(y < q AS DOUBLE))) / nullif(sum((y - c) * (tau - CAST(y < c AS DOUBLE))), 0)', 'pseudo_r')} FROM (SELECT z AS y, tau, (tau - 0.5::DOUBLE) * 2 + (ord - 3.5::DOUBLE) / 100 AS q, (tau - 0.5::DOUBLE) * 2 AS c FROM zpanel CROSS JOIN (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS tau) WHERE freq = 'monthly' AND z IS NOT NULL) GROUP BY tau",
    ),
    "pit_verdict": sql(
        "facts",
        f"SELECT target_quarter, as_of, {r('pit', 'pit')}, CASE WHEN pit BETWEEN 0.005 AND 0.5 THEN 'inside' WHEN pit > 1e-4 THEN 'edge' ELSE 'outside' END AS verdict FROM (SELECT f.target_quarter, f.as_of, count(*) FILTER (WHERE d.nowcast_level <= f.realised) / count(*) AS pit FROM facts f CROSS JOIN (SELECT nowcast_level FROM facts WHERE method = 'random_walk') d WHERE f.realised IS NOT NULL AND f.method = 'mean' GROUP BY ALL)",
    ),
    "density_describe": f"""SELECT event_type, count(*) AS n, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')}, {r('avg((value - m) ** 3) / avg((value - m) ** 2) ** 1.5', 'skew')}, {r('kurtosis_pop(value)', 'exkurt')},
        {r('quantile_cont(value, 0.05)', 'q05')}, {r('quantile_cont(value, 0.95)', 'q95')}, {r('avg(CAST(value <= 50 AS DOUBLE))', 'pit')} FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type""",
    "vol_lags": sql("z", f"SELECT date, {r('vol', 'vol')}, {r('mean3', 'mean3')}, {r('mean3_before', 'mean3_before')}, {r('vol_before', 'vol_before')} FROM vlag", _VOL),
    "ols_simple": sql("z", f"SELECT count(*) AS n, {r('regr_slope(mean3, mean3_before)', 'slope')}, {r('regr_intercept(mean3, mean3_before)', 'intercept')}, {r('regr_r2(mean3, mean3_before)', 'r2')} FROM vlag WHERE mean3_before IS NOT NULL", _VOL),
}
