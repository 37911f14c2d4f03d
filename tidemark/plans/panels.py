"""Queries over levels, calendars and panels."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import transforms as T
from ..operators import panel as P
from ..operators import profile, rolling
from ..sources.levels import monthly_levels, order_months, quarterly_target, table
from ..sources.registry import default_registry, registry_errors
from ..sources.vintages import vintage_month, with_canonical_names
from . import base
from .base import END, START, r, sql

_ID = "series, block, freq, date"


def series_registry(spark: SparkSession, sf: str):
    """The registry, and what the tables hold of each series."""
    reg = default_registry(spark).select("ord", F.col("name").alias("series"), "block", "freq", "source", "transform", "lag")
    held = monthly_levels(spark, sf).groupBy("series").agg(F.count("value").alias("months"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return reg.join(held, "series", "left").withColumn("months", F.coalesce("months", F.lit(0)))


def registry_validation(spark: SparkSession, sf: str):
    """Nations stand in for the series of a registry that breaks rules; those of region 0 are listed twice."""
    k = F.col("n_nationkey").cast("int")
    pick = lambda key, *values: F.element_at(F.array(*map(F.lit, values)), (key.cast("int") % len(values) + 1))
    rows = table(spark, sf, "nation").select(
        k.alias("ord"), F.col("n_name").alias("name"), pick(F.col("n_regionkey"), "real", "financial", "other", "odd").alias("block"), pick(k, "monthly", "quarterly", "weekly").alias("freq"),
        pick(k, "table", "current", "spread", "file").alias("source"), F.nullif(k % 10, F.lit(0)).alias("transform"), F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("components"), F.lit(0).alias("lag"), F.col("n_regionkey").alias("region"),
    )
    return registry_errors(rows.unionByName(rows.filter("region = 0")))


def panel_monthly(spark: SparkSession, sf: str):
    return monthly_levels(spark, sf)


def transform_codes(spark: SparkSession, sf: str):
    reg = default_registry(spark).filter("source = 'table'")
    dense = P.densify(monthly_levels(spark, sf), reg).select("series", "date", "value")
    each = dense.select("*", F.explode(F.array(*map(F.lit, T.CODES))).alias("code"))
    window = Window.partitionBy("series", "code").orderBy("date")
    return each.select("series", "code", "date", T.stationary(F.col("value"), F.col("code"), window).alias("value"))


def spread_series(spark: SparkSession, sf: str):
    return P.spreads(monthly_levels(spark, sf), default_registry(spark))


def quarterly_growth(spark: SparkSession, sf: str):
    return quarterly_target(spark, sf).withColumn("label", D.quarter_label(F.col("date"))).withColumn("short", D.short_label(F.col("label")))


def quarter_mask(spark: SparkSession, sf: str):
    return base.panel(spark, sf).select("series", "block", "freq", "date", "value")


def calendar_densify(spark: SparkSession, sf: str):
    reg = default_registry(spark).filter("freq = 'monthly'")
    dense = P.densify(monthly_levels(spark, sf), reg, until=F.lit("2002-03-31").cast("date"))
    return dense.select("series", "date", "value", F.col("value").isNull().alias("missing"))


def panel_pivot(spark: SparkSession, sf: str):
    names = ["shipped_qty", "order_value", "tax_gap", "growth"]
    return P.wide(base.panel(spark, sf), names)


def panel_contract(spark: SparkSession, sf: str):
    return P.contract(base.panel(spark, sf))


def block_counts(spark: SparkSession, sf: str):
    return base.panel(spark, sf).groupBy("block", "freq").agg(F.countDistinct("series").alias("n"), F.count("value").alias("n_values"))


def missing_series(spark: SparkSession, sf: str):
    partial = monthly_levels(spark, sf).filter(~F.col("series").isin("avg_tax", "order_count"))
    return P.missing_series(partial, default_registry(spark))


def code_mismatches(spark: SparkSession, sf: str):
    codes = monthly_levels(spark, sf).groupBy("series").agg(F.when(F.count(F.lit(1)) > 82, 5).otherwise(2).cast("int").alias("code"))
    return P.code_mismatches(codes, default_registry(spark))


def _vintages(spark: SparkSession, sf: str):
    """Each year's June as a vintage that knows the levels of all months before it, under older names until 1998."""
    years = F.explode(F.array(*[F.lit(y) for y in range(1996, 2002)])).alias("y")
    rows = monthly_levels(spark, sf).select("series", "date", "value", years)
    known = rows.filter(F.col("date") < F.make_date(F.col("y"), F.lit(6), F.lit(1)))
    old = F.when((F.col("series") == "order_value") & (F.col("y") <= 1998), F.lit("order_worth")).otherwise(F.col("series"))
    return known.select((F.col("y") * 100 + 6).alias("vintage_ym"), old.alias("series"), "date", "value")


def _aliases(spark: SparkSession):
    rows = [("order_value", "order_worth", 0, 199806), ("order_value", "order_value", 199806, 999912)]
    return spark.createDataFrame(rows, "series string, source string, after_ym int, until_ym int")


def alias_range_join(spark: SparkSession, sf: str):
    named = with_canonical_names(_vintages(spark, sf), _aliases(spark))
    return named.groupBy("vintage_ym", "series").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last_date"))


def vintage_names(spark: SparkSession, sf: str):
    """File names of the order months, in each of the known forms and in two that are none."""
    months = order_months(spark, sf)
    form = lambda text: F.date_format("date", text)
    names = F.array(form("yyyy-MM'.csv'"), F.concat(F.lit("XX-MD_"), form("yyyy'm'MM'.csv'")), form("yyyy-MM'-MD.csv'"), form("yyyy-M'.CSV'"), form("'notes-'yyyy-MM'.csv'"), F.concat(form("yyyy"), F.lit("-"), F.month("date") + 12, F.lit(".csv")))
    rows = months.select("date", F.explode(names).alias("file_name"))
    return rows.select("file_name", "date", vintage_month(F.col("file_name")).alias("vintage_ym"))


def revision_advance(spark: SparkSession, sf: str):
    named = with_canonical_names(_vintages(spark, sf), _aliases(spark))
    return P.newly_known(named).groupBy("vintage_ym", "series").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"))


def revision_size(spark: SparkSession, sf: str):
    day = F.col("o_orderdate").cast("date")
    early = table(spark, sf, "orders").filter(F.col("o_orderstatus") != "P").groupBy(D.month_end(day).alias("date")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("double").alias("value"))
    first = early.select(F.lit("order_value").alias("series"), "date", "value")
    return P.largest_revision(first, monthly_levels(spark, sf))


def as_of_coercion(spark: SparkSession, sf: str):
    """The order months as dates are written: as a month, with spaces, as the last day with an order."""
    texts = F.array(F.date_format("date", "yyyy-MM"), F.concat(F.lit(" "), F.date_format("date", "yyyy-M"), F.lit(" ")), F.date_format("last", "yyyy-MM-dd"))
    rows = order_months(spark, sf).select(F.explode(texts).alias("text"))
    return rows.select("text", D.as_of_day(F.col("text")).alias("day15"), D.as_of_first(F.col("text")).alias("day1"), D.last_complete_month(D.as_of_day(F.col("text"))).alias("complete"))


def quarter_labels(spark: SparkSession, sf: str):
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, sf, "orders").select(D.quarter_end(day).alias("quarter")).groupBy("quarter").agg(F.count(F.lit(1)).alias("orders"))
    label = D.quarter_label(F.col("quarter"))
    since = D.quarter_index(F.col("quarter")) - D.quarter_index(F.lit("1995-03-31").cast("date"))
    parsed = D.parse_quarter(F.concat(F.lit(" "), F.lower(label)))
    return rows.select("quarter", "orders", label.alias("label"), D.short_label(label).alias("short"), parsed.alias("parsed"), since.alias("since_1995q1"))


def publication_asof(spark: SparkSession, sf: str):
    return rolling.published(quarterly_target(spark, sf), rolling.as_of_dates(spark, START, END))


def publication_lag_cutoff(spark: SparkSession, sf: str):
    work = rolling.rolling_calendar(quarterly_target(spark, sf), rolling.as_of_dates(spark, START, END))
    return P.cutoffs(default_registry(spark), work.select("as_of").distinct())


def point_in_time_panel(spark: SparkSession, sf: str):
    as_ofs = rolling.as_of_dates(spark, START, END)
    known = P.known_on(base.panel(spark, sf), as_ofs)
    return known.groupBy("as_of", "series").agg(F.count("value").alias("n"), F.max("date").alias("last_date"), F.max_by("value", "date").alias("last_value"))


def inflight_targets(spark: SparkSession, sf: str):
    return rolling.in_flight(rolling.published(quarterly_target(spark, sf), rolling.as_of_dates(spark, START, END)))


def horizon_months(spark: SparkSession, sf: str):
    return rolling.rolling_calendar(quarterly_target(spark, sf), rolling.as_of_dates(spark, START, END))


def expanding_stats(spark: SparkSession, sf: str):
    target = quarterly_target(spark, sf)
    return rolling.history_stats(target, rolling.published(target, rolling.as_of_dates(spark, START, END)))


def standardize(spark: SparkSession, sf: str):
    return base.standardised(spark, sf).select("series", "date", "value", "mean", "std", "z")


def mm_fill(spark: SparkSession, sf: str):
    quarters = quarterly_target(spark, sf).select(F.lit("growth").alias("series"), "date", "value")
    filled = T.quarter_fill(quarters, ["series"])
    months = F.array(*[F.last_day(F.add_months("date", k)) for k in (-2, -1, 0)])
    return filled.select("series", F.col("date").alias("quarter"), F.explode(months).alias("date"), "monthly")


def mm_aggregate(spark: SparkSession, sf: str):
    window = Window.partitionBy("series").orderBy("date")
    rows = base.standardised(spark, sf).filter("freq = 'monthly'")
    made = rows.select("series", "date", T.quarter_aggregate(F.col("z"), window).alias("aggregate"))
    return made.filter(F.month("date").isin(3, 6, 9, 12))


def ragged_edge_profile(spark: SparkSession, sf: str):
    return profile.gap_classes(base.panel(spark, sf)).groupBy("series", "class").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def missing_profile(spark: SparkSession, sf: str):
    return profile.gaps(base.panel(spark, sf))


def describe_series(spark: SparkSession, sf: str):
    return profile.describe(base.panel(spark, sf))


def corr_matrix(spark: SparkSession, sf: str):
    return profile.correlations(base.panel(spark, sf))


def gram_matrix(spark: SparkSession, sf: str):
    return profile.gram(base.standardised(spark, sf).filter("freq = 'monthly'"))


def theta0_loadings(spark: SparkSession, sf: str):
    return profile.loadings(*base.factors(spark, sf))


def r2_own_block(spark: SparkSession, sf: str):
    return profile.own_r2(profile.fitted(*base.factors(spark, sf))).select("series", "block", "r2")


def variance_decomposition(spark: SparkSession, sf: str):
    return profile.own_r2(profile.fitted(*base.factors(spark, sf))).select("series", "explained", "unexplained")


def separation_matrix(spark: SparkSession, sf: str):
    return profile.separation(*base.factors(spark, sf))


def residual_corr(spark: SparkSession, sf: str):
    return profile.residual_summary(profile.fitted(*base.factors(spark, sf)), "residual")


QUERIES = {
    f.__name__: f
    for f in (
        series_registry, registry_validation, panel_monthly, transform_codes, spread_series, quarterly_growth, quarter_mask, calendar_densify, panel_pivot, panel_contract,
        block_counts, missing_series, code_mismatches, alias_range_join, vintage_names, revision_advance, revision_size, as_of_coercion, quarter_labels, publication_asof,
        publication_lag_cutoff, point_in_time_panel, inflight_targets, horizon_months, expanding_stats, standardize, mm_fill, mm_aggregate, ragged_edge_profile, missing_profile,
        describe_series, corr_matrix, gram_matrix, theta0_loadings, r2_own_block, variance_decomposition, separation_matrix, residual_corr,
    )
}

_VINTAGES = """
vint AS (SELECT y * 100 + 6 AS vintage_ym, series, date, value FROM levels CROSS JOIN (SELECT unnest(range(1996, 2002)) AS y)
  WHERE date < make_date(y, 6, 1))"""
_CLASSED = """
edges AS (SELECT *, min(CASE WHEN value IS NOT NULL THEN date END) OVER (PARTITION BY series) AS fv, max(CASE WHEN value IS NOT NULL THEN date END) OVER (PARTITION BY series) AS lv FROM panel)"""
_PAIRS = """
pairs AS (SELECT x.series AS a, y.series AS b, x.date, x.value AS x, y.value AS y FROM panel x JOIN panel y ON x.date = y.date AND x.series <= y.series WHERE x.value IS NOT NULL AND y.value IS NOT NULL)"""

SQL = {
    "series_registry": sql("levels", "SELECT CAST(ord AS INTEGER) AS ord, reg.series, block, freq, source, CAST(transform AS INTEGER) AS transform, CAST(lag AS INTEGER) AS lag, count(value) AS months, min(date) AS first_date, max(date) AS last_date FROM reg LEFT JOIN levels ON levels.series = reg.series GROUP BY ALL"),
    "registry_validation": """WITH n AS (SELECT CAST(n_nationkey AS INTEGER) AS k, n_name AS name, CAST(n_regionkey AS INTEGER) AS g FROM nation), t AS (SELECT * FROM n UNION ALL SELECT * FROM n WHERE g = 0)
        SELECT name, 'unknown block' AS error FROM t WHERE g % 4 = 3 UNION ALL SELECT name, 'unknown frequency' FROM t WHERE k % 3 = 2 UNION ALL SELECT name, 'unknown source' FROM t WHERE k % 4 = 3
        UNION ALL SELECT name, 'no transform' FROM t WHERE k % 4 IN (0, 2) AND k % 10 = 0 UNION ALL SELECT name, 'transform out of range' FROM t WHERE k % 10 > 7
        UNION ALL SELECT name, 'a spread needs two components' FROM t WHERE k % 4 = 2 AND k % 3 <> 0 UNION ALL SELECT name, 'duplicate name' FROM n WHERE g = 0""",
    "panel_monthly": sql("levels", f"SELECT series, date, {r('value', 'value')} FROM levels"),
    "transform_codes": sql(
        "coded",
        f"SELECT series, CAST(code AS INTEGER) AS code, date, {r('CASE code WHEN 1 THEN value WHEN 2 THEN value - v1 WHEN 3 THEN value - 2 * v1 + v2 WHEN 4 THEN g0 WHEN 5 THEN g0 - g1 WHEN 6 THEN g0 - 2 * g1 + g2 ELSE value / nullif(v1, 0) - 1 END', 'value')} FROM coded CROSS JOIN (SELECT unnest(range(1, 8)) AS code) WHERE source = 'table'",
    ),
    "spread_series": sql("levels", f"SELECT series, date, {r('value', 'value')} FROM spread"),
    "quarterly_growth": sql("target", f"SELECT date, {r('value', 'value')}, year(date) || 'Q' || quarter(date) AS label, right(year(date) || 'Q' || quarter(date), 4) AS short FROM target"),
    "quarter_mask": sql("panel", f"SELECT series, block, freq, date, {r('value', 'value')} FROM panel"),
    "calendar_densify": sql(
        "levels",
        f"SELECT r.series, m.date, {r('l.value', 'value')}, l.value IS NULL AS missing FROM reg r CROSS JOIN longer m LEFT JOIN levels l ON l.series = r.series AND l.date = m.date WHERE r.freq = 'monthly'",
        "longer AS (SELECT last_day(CAST(m AS DATE)) AS date FROM (SELECT unnest(generate_series(date_trunc('month', min(date)), DATE '2002-03-01', INTERVAL 1 MONTH)) AS m FROM levels))",
    ),
    "panel_pivot": sql("panel", "SELECT date, " + ", ".join(r(f"max(CASE WHEN series = '{s}' THEN value END)", s) for s in ("shipped_qty", "order_value", "tax_gap", "growth")) + " FROM panel GROUP BY date"),
    "panel_contract": sql(
        "panel",
        "SELECT bool_and(date = last_day(date)) AS month_ends, bool_and(NOT (freq = 'quarterly' AND value IS NOT NULL) OR month(date) % 3 = 0) AS quarterly_at_quarter_ends, count(DISTINCT series) AS series, count(DISTINCT date) AS months FROM panel",
    ),
    "block_counts": sql("panel", "SELECT block, freq, count(DISTINCT series) AS n, count(value) AS n_values FROM panel GROUP BY ALL"),
    "missing_series": sql("levels", "SELECT series AS name FROM reg WHERE source = 'table' AND series NOT IN (SELECT series FROM levels WHERE series NOT IN ('avg_tax', 'order_count'))"),
    "code_mismatches": sql(
        "levels",
        "SELECT series, CAST(code AS INTEGER) AS code, CAST(transform AS INTEGER) AS transform FROM (SELECT series, CASE WHEN count(*) > 82 THEN 5 ELSE 2 END AS code FROM levels GROUP BY series) JOIN reg USING (series) WHERE code IS DISTINCT FROM transform",
    ),
    "alias_range_join": sql("levels", "SELECT CAST(vintage_ym AS INTEGER) AS vintage_ym, series, count(*) AS n, max(date) AS last_date FROM vint GROUP BY ALL", _VINTAGES),
    "vintage_names": """WITH m AS (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS date FROM orders), n AS (SELECT date, unnest([strftime(date, '%Y-%m') || '.csv', 'XX-MD_' || strftime(date, '%Y') || 'm' || strftime(date, '%m') || '.csv', strftime(date, '%Y-%m') || '-MD.csv',
        year(date) || '-' || month(date) || '.CSV', 'notes-' || strftime(date, '%Y-%m') || '.csv', year(date) || '-' || (month(date) + 12) || '.csv']) AS file_name FROM m)
        SELECT file_name, date, CASE WHEN file_name LIKE 'notes%' OR file_name = year(date) || '-' || (month(date) + 12) || '.csv' THEN NULL ELSE CAST(year(date) * 100 + month(date) AS INTEGER) END AS vintage_ym FROM n""",
    "revision_advance": sql(
        "levels",
        "SELECT CAST(v.vintage_ym AS INTEGER) AS vintage_ym, v.series, count(*) AS n, min(v.date) AS first_date FROM vint v WHERE v.vintage_ym > 199606 AND NOT EXISTS (SELECT 1 FROM vint p WHERE p.vintage_ym = v.vintage_ym - 100 AND p.series = v.series AND p.date = v.date) GROUP BY ALL",
        _VINTAGES,
    ),
    "revision_size": sql(
        "levels",
        f"SELECT l.series, count(*) AS n, {r('max(abs(e.value - l.value))', 'largest')} FROM levels l JOIN (SELECT last_day(CAST(o_orderdate AS DATE)) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS value FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) e ON e.date = l.date WHERE l.series = 'order_value' GROUP BY l.series",
    ),
    "as_of_coercion": """WITH m AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS date, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1), d AS (SELECT date, last, make_date(year(date), month(date), 1) AS first FROM m)
        SELECT strftime(date, '%Y-%m') AS text, first + 14 AS day15, first AS day1, first - 1 AS complete FROM d UNION ALL SELECT ' ' || year(date) || '-' || month(date) || ' ', first + 14, first, first - 1 FROM d
        UNION ALL SELECT strftime(last, '%Y-%m-%d'), last, last, CASE WHEN last = date THEN date ELSE first - 1 END FROM d""",
    "quarter_labels": """SELECT q AS quarter, count(*) AS orders, year(q) || 'Q' || quarter(q) AS label, right(year(q) || 'Q' || quarter(q), 4) AS short, q AS parsed,
        CAST(year(q) * 4 + quarter(q) - (1995 * 4 + 1) AS INTEGER) AS since_1995q1
        FROM (SELECT last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS q FROM orders) GROUP BY q""",
    "publication_asof": sql("calendar", "SELECT * FROM lastpub"),
    "publication_lag_cutoff": sql("calendar", "SELECT as_of, series, last_day(CAST(make_date(year(as_of), month(as_of), 1) - to_months(CAST(1 + lag AS INTEGER)) AS DATE)) AS cutoff FROM reg CROSS JOIN (SELECT DISTINCT as_of FROM cal) WHERE freq = 'monthly'", base._REGISTRY),
    "point_in_time_panel": sql(
        "panel",
        f"""SELECT as_of, series, count(*) AS n, max(date) AS last_date, {r('arg_max(value, date)', 'last_value')} FROM panel JOIN dates15 ON CASE WHEN freq = 'quarterly' THEN last_day(CAST(date + to_months(CAST(lag AS INTEGER)) AS DATE)) <= as_of
            ELSE date <= last_day(CAST(make_date(year(as_of), month(as_of), 1) - to_months(CAST(1 + lag AS INTEGER)) AS DATE)) END WHERE value IS NOT NULL GROUP BY ALL""",
        f"dates15 AS (SELECT CAST(m AS DATE) + 14 AS as_of FROM (SELECT unnest(generate_series(DATE '{START}-01', DATE '{END}-01', INTERVAL 1 MONTH)) AS m))",
    ),
    "inflight_targets": sql("calendar", "SELECT as_of, last_quarter, target_end FROM flight"),
    "horizon_months": sql("calendar", "SELECT * FROM cal"),
    "expanding_stats": sql("facts", f"SELECT as_of, last_quarter, n, {r('mean', 'mean')}, {r('std', 'std')}, {r('value', 'last_value')} FROM lastpub JOIN running ON date = last_quarter"),
    "standardize": sql("z", f"SELECT series, date, {r('value', 'value')}, {r('mean', 'mean')}, {r('std', 'std')}, {r('z', 'z')} FROM zpanel"),
    "mm_fill": sql(
        "target",
        f"SELECT 'growth' AS series, o.date AS quarter, last_day(CAST(o.date - to_months(k) AS DATE)) AS date, {r('x', 'monthly')} FROM fill JOIN o ON o.i = fill.i CROSS JOIN (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS k)",
        "o AS (SELECT date, value, row_number() OVER (ORDER BY date) AS i FROM target)",
        "fill AS (SELECT i, value / 3 AS x FROM o WHERE i = 1 UNION ALL SELECT o.i, (o.value - fill.x) / 2 FROM fill JOIN o ON o.i = fill.i + 1)",
        recursive=True,
    ),
    "mm_aggregate": sql(
        "z",
        f"SELECT series, date, {r('a', 'aggregate')} FROM (SELECT series, date, z / 3 + lag(z, 1) OVER w * 2 / 3 + lag(z, 2) OVER w + lag(z, 3) OVER w * 2 / 3 + lag(z, 4) OVER w / 3 AS a FROM zpanel WHERE freq = 'monthly' WINDOW w AS (PARTITION BY series ORDER BY date)) WHERE month(date) % 3 = 0",
    ),
    "ragged_edge_profile": sql(
        "panel",
        "SELECT series, CAST(CASE WHEN value IS NOT NULL THEN 0 WHEN freq = 'quarterly' THEN 1 WHEN date < fv THEN 4 WHEN date > lv THEN 2 ELSE 3 END AS INTEGER) AS class, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM edges GROUP BY ALL",
        _CLASSED,
    ),
    "missing_profile": sql(
        "panel",
        """SELECT series, fv AS first_valid, lv AS last_valid, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS n_missing, count(*) FILTER (WHERE value IS NULL AND (fv IS NULL OR date < fv)) AS leading,
           count(*) FILTER (WHERE value IS NULL AND date BETWEEN fv AND lv) AS internal, count(*) FILTER (WHERE value IS NULL AND date > lv) AS trailing FROM edges GROUP BY ALL""",
        _CLASSED,
    ),
    "describe_series": sql(
        "panel",
        f"""SELECT series, count(value) AS n, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')}, {r('min(value)', 'min')}, {r('quantile_cont(value, 0.25)', 'p25')}, {r('quantile_cont(value, 0.5)', 'median')},
            {r('quantile_cont(value, 0.75)', 'p75')}, {r('max(value)', 'max')}, {r('avg((value - m) ** 3) / avg((value - m) ** 2) ** 1.5', 'skew')}, {r('kurtosis_pop(value)', 'exkurt')}
            FROM (SELECT *, avg(value) OVER (PARTITION BY series) AS m FROM panel) GROUP BY series""",
    ),
    "corr_matrix": sql("panel", f"SELECT a, b, count(*) AS n, {r('corr(x, y)', 'corr')} FROM pairs GROUP BY ALL", _PAIRS),
    "gram_matrix": sql(
        "z",
        f"SELECT x.series AS a, y.series AS b, {r('sum(x.z * y.z) / (SELECT count(DISTINCT date) FROM zpanel)', 'gram')} FROM zpanel x JOIN zpanel y ON x.date = y.date AND x.series <= y.series WHERE x.freq = 'monthly' AND y.freq = 'monthly' AND x.z IS NOT NULL AND y.z IS NOT NULL GROUP BY ALL",
    ),
    "theta0_loadings": sql("factors", f"SELECT series, block, {r('loading', 'loading')}, {r('var_samp(residual)', 'residual_var')} FROM fits GROUP BY series, block, loading"),
    "r2_own_block": sql(
        "factors", f"SELECT series, block, {r('least(1, greatest(0, 1 - sum(residual ** 2) / nullif(sum((z - m) ** 2), 0)))', 'r2')} FROM (SELECT *, avg(z) OVER (PARTITION BY series) AS m FROM fits) GROUP BY ALL"
    ),
    "variance_decomposition": sql("factors", f"SELECT series, {r('var_pop(fit) / nullif(var_pop(z), 0)', 'explained')}, {r('var_pop(residual) / nullif(var_pop(z), 0)', 'unexplained')} FROM fits GROUP BY series"),
    "separation_matrix": sql(
        "factors",
        f"SELECT block, factor_block, {r('avg(c * c)', 'mean_r2')} FROM (SELECT z.block, z.series, f.block AS factor_block, count(*) AS n, corr(z.z, f.factor) AS c FROM zpanel z JOIN factors f ON f.date = z.date WHERE z.freq = 'monthly' AND z.z IS NOT NULL GROUP BY ALL) WHERE n > 10 GROUP BY ALL",
    ),
    "residual_corr": sql(
        "factors",
        f"SELECT count(*) AS pairs, {r('max(abs(c))', 'largest')}, {r('avg(abs(c))', 'mean')}, {r('avg(CASE WHEN abs(c) > 0.3 THEN 1.0 ELSE 0.0 END)', 'share')} FROM (SELECT x.series, y.series AS other, corr(x.residual, y.residual) AS c FROM fits x JOIN fits y ON x.date = y.date AND x.series < y.series GROUP BY ALL) WHERE c IS NOT NULL",
    ),
}
