"""Queries over vintages, stored facts, backtest ledgers, calendars and report frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import transforms as T
from ..operators import panel as P
from ..operators import recovery, rolling
from ..operators.quantiles import exact_quantiles
from ..sources import results, vintages
from ..sources.facts import latest
from ..sources.levels import table
from ..sources.registry import default_registry
from ..storage import new_path
from ..streaming.upsert import upsert_stream
from . import base
from .base import END, START, r, sql
from .scores import _REPLICAS, _VOL, _replications, vol_lags

_TAUS = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


def _vintages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stand-in vintages at five year ends: values (with a series of an older name), codes (one that changed) and aliases."""
    ends = spark.range(1996, 2001).select((F.col("id") * 100 + 12).cast("int").alias("vintage_ym"), F.make_date("id", F.lit(12), F.lit(31)).alias("known"))
    values = base.levels(spark, sf).join(F.broadcast(ends), F.col("date") <= F.col("known"))
    old = (F.col("series") == "order_count") & (F.col("vintage_ym") < 199900)
    values = values.select("vintage_ym", F.when(old, "orders_total").otherwise(F.col("series")).alias("series"), "date", "value")
    own = F.when((F.col("name") == "shipped_qty") & (F.col("vintage_ym") < 199900), 2).otherwise(F.col("transform"))
    codes = default_registry(spark).filter("source = 'table' AND name <> 'order_count'").join(F.broadcast(ends)).select("vintage_ym", F.col("name").alias("series"), own.alias("code"))
    aliases = spark.createDataFrame([("order_count", "orders_total", 0, 199812)], "series string, source string, after_ym int, until_ym int")
    return values, codes, aliases


def _stored_vintages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stand-in vintages as files and read back: unit_price joins in 1998, and every other year the columns are in reverse order."""
    values, codes, aliases = _vintages(spark, sf)
    values = values.filter("NOT (series = 'unit_price' AND vintage_ym < 199800)")
    place = F.row_number().over(Window.partitionBy("vintage_ym").orderBy("series"))
    order = values.select("vintage_ym", "series").distinct().withColumn("place", F.when(F.floor(F.col("vintage_ym") / 100) % 2 == 1, -place).otherwise(place))
    folder = new_path(spark, "vintage-files")
    vintages.write_vintages(values, codes, folder, order)
    return *vintages.read_vintages(spark, folder), aliases


def vintage_scan(spark: SparkSession, sf: str):
    return _stored_vintages(spark, sf)[0]


def vintage_codes(spark: SparkSession, sf: str):
    return _stored_vintages(spark, sf)[1].filter("code IS NOT NULL")


def vintage_panel(spark: SparkSession, sf: str):
    """From the files to each vintage's transformed panel."""
    late = spark.createDataFrame([("order_count", 1), ("unit_price", 1)], "series string, months int")
    known = spark.createDataFrame([("unit_price", 199812)], "series string, first_ym int")
    return vintages.load_vintages(*_stored_vintages(spark, sf), default_registry(spark), late, known_late=known)


def vintage_raw_levels(spark: SparkSession, sf: str):
    values, _, aliases = _stored_vintages(spark, sf)
    return vintages.raw_levels(values, aliases, ["order_count", "unit_price"])


def current_revised(spark: SparkSession, sf: str):
    lags = default_registry(spark).select(F.col("name").alias("series"), "lag")
    return vintages.current_series(base.panel(spark, sf), ["unit_price", "avg_tax", "unknown"], "2000-06-15", lags)


def vintage_load(spark: SparkSession, sf: str):
    late = spark.createDataFrame([("order_count", 1), ("unit_price", 1)], "series string, months int")
    return vintages.load_vintages(*_vintages(spark, sf), default_registry(spark), late)


def vintage_index(spark: SparkSession, sf: str):
    months = base.levels(spark, sf).filter("series = 'order_count'").select("date")
    name = F.concat(F.date_format("date", "yyyy-MM"), F.lit(".csv"))
    folders = F.array(F.struct(F.lit("old").alias("folder"), F.lit(0).alias("place")), F.struct(F.lit("new").alias("folder"), F.lit(1).alias("place")))
    files = months.select("date", name.alias("name"), F.explode(folders).alias("f")).filter("f.folder = 'old' OR month(date) % 2 = 1").select("f.folder", "f.place", "name")
    return vintages.vintage_index(files)


def vintage_listing(spark: SparkSession, sf: str):
    values, _, _ = _vintages(spark, sf)
    return vintages.available_vintages(values)


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    """Facts written once, then those from 1999 on again, twice, with other levels."""
    first = base.facts(spark, sf).select("as_of", "target_quarter", "method", "horizon", "nowcast_level").withColumn("batch", F.lit(1))
    again = first.filter("year(as_of) >= 1999").withColumn("nowcast_level", F.col("nowcast_level") + 1).withColumn("batch", F.lit(2))
    return first.unionByName(again).unionByName(again)


def facts_upsert(spark: SparkSession, sf: str):
    return latest(_batches(spark, sf))


def facts_stream(spark: SparkSession, sf: str):
    """The same batches as files on a stream, the later batch's file first, a file in each micro-batch."""
    folder, out, checkpoint = (new_path(spark, name) for name in ("facts-in", "facts-out", "facts-checkpoint"))
    rows = _batches(spark, sf)
    for batch in (2, 1):
        rows.filter(F.col("batch") == batch).coalesce(1).write.mode("append").parquet(folder)
    upsert_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder), out, checkpoint)
    return latest(spark.read.parquet(out).drop("run"))


def backtest_ledger(spark: SparkSession, sf: str):
    """Months without a vintage are every February's; fits fail at horizon 3."""
    facts = base.facts(spark, sf)
    months = rolling.as_of_dates(spark, START, END).select((F.year("as_of") * 100 + F.month("as_of")).alias("vintage_ym")).filter("vintage_ym % 100 <> 2")
    done = facts.filter("horizon <> 3").select("as_of", "target_quarter", "method", "nowcast_level", F.col("horizon").cast("double").alias("n_iter"), "converged")
    return rolling.ledger(facts.select("as_of", "target_quarter", "horizon", "method"), months, done)


def panel_metadata(spark: SparkSession, sf: str):
    return P.metadata(base.panel(spark, sf))


def missing_pattern(spark: SparkSession, sf: str):
    return P.missing_pattern(default_registry(spark), P.calendar(base.levels(spark, sf)), ["order_count"])


def calendar_extension(spark: SparkSession, sf: str):
    return P.calendar(base.levels(spark, sf), F.lit("2002-06-15").cast("date"))


def destandardised(spark: SparkSession, sf: str):
    z = base.standardised(spark, sf).filter("z IS NOT NULL")
    return z.select("series", "date", T.destandardised(F.col("z"), F.col("mean"), F.col("std")).alias("value"))


def drift_check(spark: SparkSession, sf: str):
    """Stored moments are those of the panel but for one series that is off and one that is lacking."""
    stats = base.standardised(spark, sf).select("series", "mean", "std").distinct()
    stored = stats.filter("series <> 'avg_tax'").withColumn("mean", F.when(F.col("series") == "unit_price", F.col("mean") + 0.5).otherwise(F.col("mean")))
    return results.drifted(stats, stored, ["series"]).select("series", "off")


def json_safe_levels(spark: SparkSession, sf: str):
    bad = F.when(F.month("date") == 1, F.lit(float("nan"))).when(F.month("date") == 2, F.lit(float("inf"))).otherwise(F.col("value"))
    return results.json_safe(base.levels(spark, sf).withColumn("value", bad))


def json_safe_nested(spark: SparkSession, sf: str):
    """A year's levels as an array of structs, some of which hold no number, read back from JSON."""
    bad = F.when(F.month("date") == 1, F.lit(float("nan"))).when(F.month("date") == 2, F.lit(float("-inf"))).otherwise(F.col("value"))
    rows = base.levels(spark, sf).groupBy("series", F.year("date").alias("year")).agg(F.array_sort(F.collect_list(F.struct("date", bad.alias("value")))).alias("months"))
    path = new_path(spark, "nested")
    results.write_json(rows, path)
    back = results.read_json(spark, path, "series string, year int, months array<struct<date:date,value:double>>")
    return back.select("series", "year", F.explode("months").alias("m")).select("series", "year", "m.date", "m.value")


def resume_settings(spark: SparkSession, sf: str):
    """Work and results of a grid over the as-of months: those before 1999 were done with 50 iterations, those of one method under other settings."""
    work = base.facts(spark, sf).select("as_of", "target_quarter", "method").withColumn("max_iter", F.lit(100)).withColumn("tolerance", F.lit(0.001))
    done = work.filter("method <> 'mean'").withColumn("max_iter", F.when(F.year("as_of") < 1999, 50).otherwise(100)).withColumn("tolerance", F.when(F.col("method") == "seasonal", 0.01).otherwise(0.001))
    todo, kept, stale = results.resumed(work, done, ["as_of", "target_quarter", "method"], ["max_iter", "tolerance"])
    each = [df.select("as_of", "target_quarter", "method", F.lit(name).alias("state")) for df, name in ((todo, "todo"), (kept, "kept"), (stale, "stale"))]
    return each[0].unionByName(each[1]).unionByName(each[2])


def report_advantage(spark: SparkSession, sf: str):
    made = recovery.advantage(recovery.replication_summary(_replications(spark, sf), _truths(spark)), "1")
    return made.select("metric", "scenario", *[F.round(c, 3).alias(c) for c in ("mean", "advantage")], "gap")


def report_side_by_side(spark: SparkSession, sf: str):
    names = [str(i) for i in range(1, 6)]
    made = recovery.side_by_side(recovery.replication_summary(_replications(spark, sf), _truths(spark)), names)
    return made.select("metric", *[F.round(F.col(f"`{n}`"), 3).alias(f"scenario_{n}") for n in names])


def _truths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("rho_hat", 150000.0)], "metric string, truth double")


def density_quantiles(spark: SparkSession, sf: str):
    """Seven quantiles and the Gaussian probability of 50, by type of event."""
    events = table(spark, sf, "events")
    moments = events.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    own = exact_quantiles(events, ["event_type"], "value", {f"q{round(100 * t):02d}": t for t in _TAUS})
    return moments.join(own, "event_type").withColumn("gaussian_pit", T.normal_cdf((F.lit(50.0) - F.col("mean")) / F.col("std")))


def vol_regression(spark: SparkSession, sf: str):
    return recovery.least_squares_two(vol_lags(spark, sf), "mean3", "mean3_before", "vol_before")


QUERIES = {
    f.__name__: f
    for f in (
        facts_stream, vintage_scan, vintage_codes, vintage_panel, vintage_raw_levels, current_revised, vintage_load, vintage_index, vintage_listing, facts_upsert, backtest_ledger, panel_metadata, missing_pattern, calendar_extension, destandardised, drift_check,
        json_safe_levels, json_safe_nested, resume_settings, report_advantage, report_side_by_side, density_quantiles, vol_regression,
    )
}

_ENDS = "ends AS (SELECT CAST(y * 100 + 12 AS INTEGER) AS vintage_ym, make_date(y, 12, 31) AS known FROM (SELECT unnest(generate_series(1996, 2000)) AS y))"
_LOADED = """
vals AS (SELECT vintage_ym, series, date, value FROM levels JOIN ends ON date <= known),
span AS (SELECT vintage_ym, min(date) AS a, max(date) AS b FROM vals GROUP BY vintage_ym),
vdays AS (SELECT vintage_ym, b, last_day(CAST(m AS DATE)) AS date FROM (SELECT vintage_ym, b, unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS m FROM span)),
vgrid AS (SELECT d.vintage_ym, d.b, d.date, r.series, CASE WHEN r.series = 'shipped_qty' AND d.vintage_ym < 199900 THEN 2 ELSE r.transform END AS transform,
   CASE WHEN r.series IN ('order_count', 'unit_price') THEN 1 ELSE 0 END AS late FROM vdays d CROSS JOIN reg r WHERE r.source = 'table'),
vdense AS (SELECT g.*, v.value FROM vgrid g LEFT JOIN vals v ON v.vintage_ym = g.vintage_ym AND v.series = g.series AND v.date = g.date),
vcoded AS (SELECT *, lag(value, 1) OVER w AS v1, lag(value, 2) OVER w AS v2,
   CASE WHEN value > 0 THEN ln(value) END AS g0, lag(CASE WHEN value > 0 THEN ln(value) END, 1) OVER w AS g1, lag(CASE WHEN value > 0 THEN ln(value) END, 2) OVER w AS g2
   FROM vdense WINDOW w AS (PARTITION BY vintage_ym, series ORDER BY date)),
vmade AS (SELECT vintage_ym, series, date, CASE WHEN date <= last_day(CAST(b - to_months(late) AS DATE)) THEN CASE transform WHEN 1 THEN value WHEN 2 THEN value - v1 WHEN 3 THEN value - 2 * v1 + v2
    WHEN 4 THEN g0 WHEN 5 THEN g0 - g1 WHEN 6 THEN g0 - 2 * g1 + g2 ELSE value / nullif(v1, 0) - 1 END END AS value FROM vcoded)"""
_MEANS = "means AS (SELECT metric, scenario, avg(value) AS mean FROM rep GROUP BY ALL)"
_PIT_X = "((50.0::DOUBLE - mean) / std)"
_PIT_T = f"(1 / (1 + {T.NORMAL_P}::DOUBLE * abs({_PIT_X}) / sqrt(2.0::DOUBLE)))"
_PIT_HALF = "0.5::DOUBLE * (" + " + ".join(f"({a}::DOUBLE) * {_PIT_T} ** {k + 1}" for k, a in enumerate(T.NORMAL_A)) + f") * exp(-{_PIT_X} * {_PIT_X} / 2)"
_OLS2 = """
used AS (SELECT mean3 AS y, mean3_before AS x1, vol_before AS x2 FROM vlag WHERE mean3 IS NOT NULL AND mean3_before IS NOT NULL AND vol_before IS NOT NULL),
s AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y, var_pop(y) AS syy FROM used),
b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s)"""

_FILES = """
fdays AS (SELECT DISTINCT vintage_ym, date FROM vals), fseries AS (SELECT DISTINCT vintage_ym, series FROM vals WHERE series <> 'unit_price' OR vintage_ym > 199800),
cells AS (SELECT d.vintage_ym, d.date, s.series, v.value FROM fdays d JOIN fseries s ON s.vintage_ym = d.vintage_ym LEFT JOIN vals v ON v.vintage_ym = d.vintage_ym AND v.date = d.date AND v.series = s.series)"""
_NAMED = "CASE WHEN series = 'order_count' AND vintage_ym < 199900 THEN 'orders_total' ELSE series END AS series"

SQL = {
    "vintage_scan": sql("levels", f"SELECT vintage_ym, {_NAMED}, date, {r('value', 'value')} FROM cells", _ENDS, _LOADED, _FILES),
    "vintage_codes": sql(
        "levels",
        "SELECT f.vintage_ym, f.series, CASE WHEN f.series = 'shipped_qty' AND f.vintage_ym < 199900 THEN 2 ELSE transform END AS code FROM fseries f JOIN reg r ON r.series = f.series WHERE f.series <> 'order_count'",
        _ENDS, _LOADED, _FILES,
    ),
    "vintage_panel": sql("levels", f"SELECT vintage_ym, series, date, {r('CASE WHEN series <> ' + chr(39) + 'unit_price' + chr(39) + ' OR vintage_ym > 199800 THEN value END', 'value')} FROM vmade", _ENDS, _LOADED),
    "vintage_raw_levels": sql(
        "levels",
        f"SELECT d.vintage_ym, d.date, s.series, {r('c.value', 'value')} FROM fdays d CROSS JOIN (VALUES ('order_count'), ('unit_price')) s(series) LEFT JOIN cells c ON c.vintage_ym = d.vintage_ym AND c.date = d.date AND c.series = s.series",
        _ENDS, _LOADED, _FILES,
    ),
    "current_revised": sql("panel", f"SELECT series, date, {r('value', 'value')} FROM panel WHERE value IS NOT NULL AND series IN ('unit_price', 'avg_tax') AND date <= CASE WHEN series = 'unit_price' THEN DATE '2000-04-30' ELSE DATE '2000-05-31' END"),
    "vintage_load": sql("levels", f"SELECT vintage_ym, series, date, {r('value', 'value')} FROM vmade", _ENDS, _LOADED),
    "vintage_index": sql(
        "levels",
        "SELECT CAST(year(date) * 100 + month(date) AS INTEGER) AS vintage_ym, CASE WHEN month(date) % 2 = 1 THEN 'new' ELSE 'old' END AS folder, strftime(date, '%Y-%m') || '.csv' AS name FROM levels WHERE series = 'order_count'",
    ),
    "vintage_listing": sql("levels", "SELECT DISTINCT vintage_ym FROM levels JOIN ends ON date <= known WHERE vintage_ym >= 200008", _ENDS),
    "facts_upsert": sql("facts", f"SELECT as_of, target_quarter, method, horizon, {r('CASE WHEN year(as_of) >= 1999 THEN nowcast_level + 1 ELSE nowcast_level END', 'nowcast_level')} FROM facts"),
    "facts_stream": sql("facts", f"SELECT as_of, target_quarter, method, horizon, {r('CASE WHEN year(as_of) >= 1999 THEN nowcast_level + 1 ELSE nowcast_level END', 'nowcast_level')} FROM facts"),
    "backtest_ledger": sql(
        "facts",
        f"SELECT as_of, target_quarter, horizon, method, {r('CASE WHEN horizon <> 3 THEN nowcast_level END', 'nowcast_level')}, {r('CASE WHEN horizon <> 3 THEN horizon ELSE -1 END', 'n_iter')}, horizon <> 3 AS converged FROM facts WHERE month(as_of) <> 2",
    ),
    "panel_metadata": sql(
        "panel",
        f"SELECT series, block, freq, CAST(lag AS INTEGER) AS lag, count(*) AS months, count(value) AS n, {r('1 - count(value) / count(*)', 'missing_share')}, min(date) FILTER (WHERE value IS NOT NULL) AS first_date, max(date) FILTER (WHERE value IS NOT NULL) AS last_date FROM panel GROUP BY ALL",
    ),
    "missing_pattern": sql(
        "coded",
        "SELECT r.series, m.date, (r.series <> 'order_count' AND m.date > last_day(CAST(last - to_months(CAST(r.lag AS INTEGER)) AS DATE))) OR (r.freq = 'quarterly' AND month(m.date) % 3 <> 0) AS missing FROM reg r CROSS JOIN months m CROSS JOIN (SELECT max(date) AS last FROM months)",
    ),
    "calendar_extension": sql(
        "levels",
        "SELECT last_day(CAST(m AS DATE)) AS date FROM (SELECT unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', greatest(max(date), DATE '2002-06-15')), INTERVAL 1 MONTH)) AS m FROM levels)",
    ),
    "destandardised": sql("z", f"SELECT series, date, {r('z * std + mean', 'value')} FROM zpanel WHERE z IS NOT NULL"),
    "drift_check": sql("z", f"SELECT DISTINCT series, {r(chr(67) + 'ASE WHEN series = ' + chr(39) + 'unit_price' + chr(39) + ' THEN 0.5 END', 'off')} FROM zpanel WHERE series IN ('unit_price', 'avg_tax')"),
    "json_safe_levels": sql("levels", f"SELECT series, date, {r('CASE WHEN month(date) > 2 THEN value END', 'value')} FROM levels"),
    "json_safe_nested": sql("levels", f"SELECT series, CAST(year(date) AS INTEGER) AS year, date, {r('CASE WHEN month(date) > 2 THEN value END', 'value')} FROM levels"),
    "resume_settings": sql(
        "facts",
        """SELECT as_of, target_quarter, method, unnest(CASE WHEN method = 'mean' THEN ['todo'] WHEN method = 'seasonal' OR year(as_of) < 1999 THEN ['todo', 'stale'] ELSE ['kept'] END) AS state FROM facts""",
    ),
    "report_advantage": "WITH " + _REPLICAS + ", " + _MEANS + f" SELECT m.metric, m.scenario, {r('round(m.mean, 3)', 'mean')}, {r('round(o.mean - m.mean, 3)', 'advantage')}, {r('m.mean / o.mean - 1', 'gap')} FROM means m JOIN means o ON o.metric = m.metric AND o.scenario = '1'",
    "report_side_by_side": "WITH " + _REPLICAS + ", " + _MEANS + " SELECT metric, " + ", ".join(r(f"round(max(mean) FILTER (WHERE scenario = '{i}'), 3)", f"scenario_{i}") for i in range(1, 6)) + " FROM means GROUP BY metric",
    "density_quantiles": "SELECT event_type, n, "
    + ", ".join(r(c, c) for c in ("mean", "std", *[f"q{round(100 * t):02d}" for t in _TAUS]))
    + f", {r(f'CASE WHEN {_PIT_X} >= 0 THEN 1 - {_PIT_HALF} ELSE {_PIT_HALF} END', 'gaussian_pit')} FROM (SELECT event_type, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, "
    + ", ".join(f"quantile_cont(value, {t}) AS q{round(100 * t):02d}" for t in _TAUS)
    + " FROM events GROUP BY event_type)",
    "vol_regression": sql("z", f"SELECT n, {r('b1', 'slope_1')}, {r('b2', 'slope_2')}, {r('my - b1 * m1 - b2 * m2', 'intercept')}, {r('(b1 * s1y + b2 * s2y) / syy', 'r2')} FROM b", _VOL, _OLS2),
}
