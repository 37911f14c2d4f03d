"""Queries that fit models; SQL can't express them but for the scalar filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import quarter_index
from ..functions.transforms import standardise
from ..operators import benchmarks, densities, factor_model, montecarlo, panel as P, recovery, rolling, tails
from ..operators.scalar_filter import scalar_filter, scalar_smoother
from ..sources.levels import quarterly_target, table
from . import base
from .base import r, sql


def _panels(spark: SparkSession, sf: str) -> DataFrame:
    """A panel for each as_of and target in flight: what was known, on a calendar that reaches to the target, standardised by itself."""
    target = quarterly_target(spark, sf)
    work = rolling.rolling_calendar(target, rolling.as_of_dates(spark, base.START, base.END))
    full = base.panel(spark, sf)
    known = P.known_on(full, work.select("as_of").distinct()).select("as_of", "series", "date", "value")
    months = full.select("series", "block", "freq", "ord", "date").join(F.broadcast(work), F.col("date") <= F.greatest(F.col("target_end"), F.last_day("as_of")))
    rows = months.join(known, ["as_of", "series", "date"], "left").filter("date >= date'1995-01-31'")
    rows = rows.withColumn("fit_id", F.concat_ws("|", F.col("as_of").cast("string"), "target_quarter"))
    return standardise(rows, ["fit_id", "series"]).filter("date <= target_end")


def dfm_fit(spark: SparkSession, sf: str):
    made = factor_model.fit_models(_panels(spark, sf), ("student_t",))
    return made.select("fit_id", F.explode(F.arrays_zip("series", "loading", "noise")).alias("x")).select("fit_id", "x.series", "x.loading", "x.noise")


def dfm_nowcast(spark: SparkSession, sf: str):
    return factor_model.nowcasts(_panels(spark, sf), ("student_t", "gaussian"))


def arma_nowcast(spark: SparkSession, sf: str):
    target = quarterly_target(spark, sf)
    work = rolling.rolling_calendar(target, rolling.as_of_dates(spark, base.START, base.END))
    steps = quarter_index(F.col("target_end")) - quarter_index(F.col("last_quarter"))
    histories = work.select("as_of", "target_quarter", "last_quarter", steps.alias("steps")).join(target, F.col("date") <= F.col("last_quarter"))
    return benchmarks.arma_nowcasts(histories.select("as_of", "target_quarter", "steps", "date", "value"))


def mc_grid(spark: SparkSession, sf: str):
    """Panels as long as the given series are, and half as long."""
    lengths = base.levels(spark, sf).groupBy("series").agg(F.count(F.lit(1)).cast("int").alias("n")).agg(F.max("n")).first()[0]
    done = montecarlo.replications(montecarlo.grid(spark, [lengths // 2, lengths], ["student_t", "gaussian"], [0.0, 0.05], 2))
    truths = spark.createDataFrame([], "metric string, truth double")
    return recovery.replication_summary(montecarlo.long_metrics(done), truths)


def quantile_tails(spark: SparkSession, sf: str):
    z, factors = base.factors(spark, sf)
    wide = factors.groupBy("date").pivot("block", ["real", "financial", "other"]).agg(F.first("factor"))
    rows = z.filter("series = 'order_value' AND z IS NOT NULL").select("date", F.lit("order_value").alias("key"), F.col("z").alias("y")).join(wide, "date").na.drop()
    return tails.tail_summary(tails.quantile_regressions(rows, ["financial", "other"]), "financial")


def density_simulated(spark: SparkSession, sf: str):
    target = quarterly_target(spark, sf)
    parameters = target.groupBy(F.year("date").cast("string").alias("key")).agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(1.0)).alias("sd")).withColumn("nu", F.lit(5.0))
    realised = target.groupBy(F.year("date").cast("string").alias("key")).agg(F.max_by("value", "date").alias("realised"))
    return tails.describe_draws(tails.density_draws(spark, parameters, 20_000), realised)


def _skewed(spark: SparkSession, sf: str) -> DataFrame:
    """A density for each type of event, whose skew and tails follow from its moments."""
    m = table(spark, sf, "events").groupBy(F.col("event_type").alias("key")).agg(F.avg("value").alias("xi"), F.stddev_samp("value").alias("omega"), F.avg((F.col("value") < 50).cast("double")).alias("low_share"), F.count(F.lit(1)).alias("n"))
    m = m.select("key", "xi", "omega", (4 * F.col("low_share") - 2).alias("alpha"), (3 + F.col("n") % 7).cast("double").alias("nu"))
    return m.withColumn("low", F.col("xi") - 6 * F.col("omega")).withColumn("high", F.col("xi") + 6 * F.col("omega"))


def skewed_quantiles(spark: SparkSession, sf: str):
    return densities.quantiles_of(densities.skewed_grid(_skewed(spark, sf), 500), list(tails.TAUS))


def skewed_probability(spark: SparkSession, sf: str):
    """The share of each day's mean value under its type's density."""
    events = table(spark, sf, "events").groupBy(F.col("event_type").alias("key"), F.col("ts").cast("date").alias("date")).agg(F.avg("value").alias("value"))
    return densities.probabilities_of(densities.skewed_grid(_skewed(spark, sf), 500), events)


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.standardised(spark, sf).filter("freq = 'monthly'")
    return rows.select(F.col("series").alias("key"), "date", F.col("z").alias("y"))


def scalar_kalman(spark: SparkSession, sf: str):
    return scalar_filter(_observed(spark, sf).filter("date >= date'1995-03-31'"), 0.9, 0.2, 0.5)


def scalar_smooth(spark: SparkSession, sf: str):
    return scalar_smoother(_observed(spark, sf), 0.9, 0.2, 0.5)


QUERIES = {f.__name__: f for f in (dfm_fit, dfm_nowcast, arma_nowcast, mc_grid, quantile_tails, density_simulated, scalar_kalman, scalar_smooth, skewed_quantiles, skewed_probability)}

_RULE = "[" + ", ".join(f"{{'node': {n!r}::DOUBLE, 'weight': {w!r}::DOUBLE}}" for n, w in zip(densities.NODES, densities.WEIGHTS, strict=True)) + "]"
_ARC = lambda upper: f"({upper} / 2 * list_sum(list_transform(rule, lambda r: r.weight * cos({upper} * (0.5::DOUBLE + 0.5::DOUBLE * r.node)) ** nu)))"
_SKEWED = f"""WITH m AS (SELECT event_type AS key, avg(value) AS xi, stddev_samp(value) AS omega, 4 * avg(CAST(value < 50 AS DOUBLE)) - 2 AS alpha, CAST(3 + count(*) % 7 AS DOUBLE) AS nu FROM events GROUP BY 1),
g AS (SELECT *, xi - 6 * omega + i * (12 * omega / 499) AS x, {_RULE} AS rule FROM m CROSS JOIN (SELECT unnest(range(500)) AS i)),
z AS (SELECT *, (x - xi) / omega AS z FROM g),
u AS (SELECT *, atan(alpha * z * sqrt((nu + 1) / (z * z + nu)) / sqrt(nu + 1)) AS u FROM z),
f AS (SELECT key, i, x, omega, (1 + z * z / nu) ** (-(nu + 1) / 2) * (0.5::DOUBLE + 0.5::DOUBLE * {_ARC('u')} / {_ARC('(pi() / 2)')}) AS pdf FROM u),
a AS (SELECT *, coalesce((pdf + lag(pdf) OVER (PARTITION BY key ORDER BY i)) / 2 * 12 * omega / 499, 0) AS area FROM f),
c AS (SELECT key, i, x, sum(area) OVER (PARTITION BY key ORDER BY i) / sum(area) OVER (PARTITION BY key) AS cdf FROM a),
n AS (SELECT *, lead(x) OVER (PARTITION BY key ORDER BY i) AS nx, lead(cdf) OVER (PARTITION BY key ORDER BY i) AS nc FROM c)"""

SQL = {
    "skewed_quantiles": f"{_SKEWED} SELECT key, tau, {r('x + (tau - cdf) / (nc - cdf) * (nx - x)', 'q')} FROM n JOIN (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in tails.TAUS)}]) AS tau) ON cdf <= tau AND tau < nc",
    "skewed_probability": f"{_SKEWED}, d AS (SELECT event_type AS key, CAST(ts AS DATE) AS date, avg(value) AS value FROM events GROUP BY ALL) SELECT d.key, date, {r('value', 'value')}, {r('cdf + (value - x) / (nx - x) * (nc - cdf)', 'pit')} FROM d JOIN n ON n.key = d.key AND value >= x AND value < nx",
    "scalar_kalman": sql(
        "z",
        f"SELECT key, date, {r('m', 'mean')}, {r('p', 'variance')}, {r('ll', 'loglik')} FROM k WHERE i > 0",
        "o AS (SELECT series AS key, date, z AS y, row_number() OVER (PARTITION BY series ORDER BY date) AS i FROM zpanel WHERE freq = 'monthly' AND date >= DATE '1995-03-31')",
        """k AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, NULL::DATE AS date, 0.0::DOUBLE AS m, 1.0::DOUBLE AS p, 0.0::DOUBLE AS ll FROM o
           UNION ALL SELECT o.key, o.i, o.date,
             CASE WHEN y IS NULL THEN 0.9::DOUBLE * m ELSE 0.9::DOUBLE * m + (0.81::DOUBLE * p + 0.2::DOUBLE) / (0.81::DOUBLE * p + 0.2::DOUBLE + 0.5::DOUBLE) * (y - 0.9::DOUBLE * m) END,
             CASE WHEN y IS NULL THEN 0.81::DOUBLE * p + 0.2::DOUBLE ELSE (0.81::DOUBLE * p + 0.2::DOUBLE) * 0.5::DOUBLE / (0.81::DOUBLE * p + 0.2::DOUBLE + 0.5::DOUBLE) END,
             ll + CASE WHEN y IS NULL THEN 0 ELSE -0.5::DOUBLE * (ln(2 * pi()) + ln(0.81::DOUBLE * p + 0.7::DOUBLE) + (y - 0.9::DOUBLE * m) * (y - 0.9::DOUBLE * m) / (0.81::DOUBLE * p + 0.7::DOUBLE)) END
           FROM k JOIN o ON o.key = k.key AND o.i = k.i + 1)""",
        recursive=True,
    ),
    "scalar_smooth": sql(
        "z",
        f"SELECT key, date, {r('ms', 'mean')}, {r('ps', 'variance')}, {r('ps * 0.9 * p0 / (0.81 * p0 + 0.2)', 'lag_one')} FROM back",
        "o AS (SELECT series AS key, date, z AS y, row_number() OVER (PARTITION BY series ORDER BY date) AS i, count(*) OVER (PARTITION BY series) AS n FROM zpanel WHERE freq = 'monthly')",
        """fwd AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, n, NULL::DATE AS date, 0.0::DOUBLE AS m, 1.0::DOUBLE AS p, 1.0::DOUBLE AS p0 FROM o
           UNION ALL SELECT o.key, o.i, o.n, o.date,
             CASE WHEN y IS NULL THEN 0.9::DOUBLE * m ELSE 0.9::DOUBLE * m + (0.81::DOUBLE * p + 0.2::DOUBLE) / (0.81::DOUBLE * p + 0.7::DOUBLE) * (y - 0.9::DOUBLE * m) END,
             CASE WHEN y IS NULL THEN 0.81::DOUBLE * p + 0.2::DOUBLE ELSE (0.81::DOUBLE * p + 0.2::DOUBLE) * 0.5::DOUBLE / (0.81::DOUBLE * p + 0.7::DOUBLE) END, p
           FROM fwd JOIN o ON o.key = fwd.key AND o.i = fwd.i + 1)""",
        """back AS (SELECT key, i, date, p0, m AS ms, p AS ps FROM fwd WHERE i = n
           UNION ALL SELECT f.key, f.i, f.date, f.p0, f.m + 0.9::DOUBLE * f.p / (0.81::DOUBLE * f.p + 0.2::DOUBLE) * (b.ms - 0.9::DOUBLE * f.m),
             f.p + (0.9::DOUBLE * f.p / (0.81::DOUBLE * f.p + 0.2::DOUBLE)) ** 2 * (b.ps - 0.81::DOUBLE * f.p - 0.2::DOUBLE)
           FROM back b JOIN fwd f ON f.key = b.key AND f.i = b.i - 1 WHERE b.i > 1)""",
        recursive=True,
    ),
}
