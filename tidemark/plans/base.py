"""What the catalogue's queries start from, as DataFrames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.transforms import standardise
from ..operators import panel as P
from ..operators import profile, rolling
from ..sources.levels import monthly_levels, quarterly_target
from ..sources.registry import default_registry

#: The rolling calendar of the stand-in data.
START, END = "1996-06", "2001-07"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, so that engines whose sums differ in the last bits agree; -0.0 becomes 0.0."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def levels(spark: SparkSession, sf: str) -> DataFrame:
    return monthly_levels(spark, sf)


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """The dense panel with the masked quarterly target: series, block, freq, lag, ord, date, value; kept, as it has a row for a series and month."""
    registry = default_registry(spark)
    monthly = P.transformed(monthly_levels(spark, sf), registry)
    full = P.with_target(monthly, quarterly_target(spark, sf), registry)
    return full.select("series", "block", "freq", "lag", "ord", "date", "value").repartition(1).persist()


def standardised(spark: SparkSession, sf: str) -> DataFrame:
    """The panel with each series' mean, std and z; kept like the panel."""
    return standardise(panel(spark, sf), ["series"]).repartition(1).persist()


def facts(spark: SparkSession, sf: str) -> DataFrame:
    target = quarterly_target(spark, sf)
    calendar = rolling.rolling_calendar(target, rolling.as_of_dates(spark, START, END))
    made = rolling.benchmark_facts(calendar, target)
    return made.withColumn("period", F.when(F.year("as_of") < 1999, "1996-06_1998-12").otherwise("1999-01_2001-07"))


def factors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The standardised panel and its blocks' stand-in factors, a row for a block and month; both kept."""
    z = standardised(spark, sf)
    return z, profile.block_factors(z).repartition(1).persist()


def weights(spark: SparkSession, sf: str) -> DataFrame:
    """(key, date, w_true, w_hat, contaminated): weights that fall with the size of order values and of order counts."""
    z = standardised(spark, sf).filter("z IS NOT NULL")
    w = lambda name: F.max(F.when(F.col("series") == name, 5.0 / (4.0 + F.col("z") * F.col("z"))))
    rows = z.filter(F.col("series").isin("order_value", "order_count")).groupBy("date").agg(w("order_value").alias("w_true"), w("order_count").alias("w_hat"))
    rows = rows.filter("w_true IS NOT NULL AND w_hat IS NOT NULL")
    return rows.select(F.lit("orders").alias("key"), "date", F.round("w_true", 9).alias("w_true"), F.round("w_hat", 9).alias("w_hat"), (F.col("w_true") < 0.8).alias("contaminated"))


_REGISTRY = """
reg(ord, series, block, freq, source, transform, lag) AS (VALUES
  (0, 'shipped_qty', 'real', 'monthly', 'table', 5, 0), (1, 'order_value', 'real', 'monthly', 'table', 5, 0),
  (2, 'order_count', 'real', 'monthly', 'table', 5, 1), (3, 'avg_discount', 'financial', 'monthly', 'table', 2, 0),
  (4, 'avg_tax', 'financial', 'monthly', 'table', 2, 0), (5, 'tax_gap', 'financial', 'monthly', 'spread', 1, 0),
  (6, 'unit_price', 'other', 'monthly', 'table', 6, 1), (7, 'avg_quantity', 'other', 'monthly', 'table', 4, 0),
  (8, 'growth', 'other', 'quarterly', 'current', NULL, 1))"""

_LEVELS = """
line AS (SELECT last_day(CAST(l_shipdate AS DATE)) AS date,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS shipped_qty,
    CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_discount,
    CAST(sum(CAST(l_tax AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_tax,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS unit_price,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_quantity
  FROM lineitem GROUP BY 1),
ord AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS date,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS order_value, CAST(count(*) AS DOUBLE) AS order_count
  FROM orders GROUP BY 1),
levels AS (
  SELECT 'shipped_qty' AS series, date, shipped_qty AS value FROM line UNION ALL SELECT 'avg_discount', date, avg_discount FROM line
  UNION ALL SELECT 'avg_tax', date, avg_tax FROM line UNION ALL SELECT 'unit_price', date, unit_price FROM line
  UNION ALL SELECT 'avg_quantity', date, avg_quantity FROM line
  UNION ALL SELECT 'order_value', date, order_value FROM ord UNION ALL SELECT 'order_count', date, order_count FROM ord),
spread AS (SELECT 'tax_gap' AS series, date, avg_tax - avg_discount AS value FROM line),
every AS (SELECT * FROM levels UNION ALL SELECT * FROM spread),
months AS (SELECT last_day(CAST(m AS DATE)) AS date FROM (SELECT unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS m FROM every)),
dense AS (SELECT r.*, m.date, e.value FROM reg r CROSS JOIN months m LEFT JOIN every e ON e.series = r.series AND e.date = m.date WHERE r.freq = 'monthly')"""

_TARGET = """
tmonth AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS month, sum(CAST(o_totalprice AS DECIMAL(18,4))) AS total, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1),
tquarter AS (SELECT last_day(make_date(year(month), quarter(month) * 3, 1)) AS date, CAST(sum(total) AS DOUBLE) AS total, count(*) AS n
  FROM tmonth WHERE date_diff('day', last, month) < 7 GROUP BY 1),
target AS (SELECT a.date, 100 * (ln(a.total) - ln(b.total)) AS value FROM tquarter a JOIN tquarter b ON b.date = last_day(CAST(a.date - INTERVAL 3 MONTH AS DATE)) WHERE a.n = 3 AND b.n = 3)"""

_CODED = """
coded AS (SELECT *, lag(value, 1) OVER w AS v1, lag(value, 2) OVER w AS v2,
   CASE WHEN value > 0 THEN ln(value) END AS g0, lag(CASE WHEN value > 0 THEN ln(value) END, 1) OVER w AS g1, lag(CASE WHEN value > 0 THEN ln(value) END, 2) OVER w AS g2
   FROM dense WINDOW w AS (PARTITION BY series ORDER BY date))"""

_PANEL = """
monthly AS (SELECT series, block, freq, lag, ord, date, CASE transform WHEN 1 THEN value WHEN 2 THEN value - v1 WHEN 3 THEN value - 2 * v1 + v2
    WHEN 4 THEN g0 WHEN 5 THEN g0 - g1 WHEN 6 THEN g0 - 2 * g1 + g2 ELSE value / nullif(v1, 0) - 1 END AS value FROM coded),
panel AS (SELECT * FROM monthly UNION ALL
  SELECT r.series, r.block, r.freq, r.lag, r.ord, m.date, CASE WHEN month(m.date) IN (3, 6, 9, 12) THEN t.value END
  FROM reg r CROSS JOIN months m LEFT JOIN target t ON t.date = m.date WHERE r.freq = 'quarterly')"""

_Z = """
moments AS (SELECT series, CASE WHEN count(value) < 2 THEN 0 ELSE avg(value) END AS mean,
    CASE WHEN count(value) < 2 THEN 1 ELSE coalesce(nullif(stddev_samp(value), 0), 1) END AS std FROM panel GROUP BY series),
zpanel AS (SELECT p.*, mean, std, (value - mean) / std AS z FROM panel p JOIN moments USING (series))"""

_FACTORS = """
factors AS (SELECT block, date, avg(z) AS factor FROM zpanel WHERE freq = 'monthly' AND z IS NOT NULL GROUP BY ALL),
joined AS (SELECT z.series, z.block, z.date, z.z, f.factor FROM zpanel z JOIN factors f ON f.block = z.block AND f.date = z.date WHERE z.freq = 'monthly' AND z.z IS NOT NULL),
loads AS (SELECT series, block, sum(z * factor) / sum(factor * factor) AS loading FROM joined GROUP BY ALL),
fits AS (SELECT j.*, loading, loading * factor AS fit, z - loading * factor AS residual FROM joined j JOIN loads l ON l.series = j.series)"""

_CALENDAR = f"""
dates15 AS (SELECT CAST(m AS DATE) + 14 AS as_of FROM (SELECT unnest(generate_series(DATE '{START}-01', DATE '{END}-01', INTERVAL 1 MONTH)) AS m)),
lastpub AS (SELECT as_of, max(date) AS last_quarter FROM dates15 JOIN target ON last_day(CAST(date + INTERVAL 1 MONTH AS DATE)) <= as_of GROUP BY as_of),
quarters AS (SELECT last_day(CAST(m AS DATE)) AS target_end FROM (SELECT unnest(generate_series(DATE '1990-03-01', DATE '2010-12-01', INTERVAL 3 MONTH)) AS m)),
flight AS (SELECT as_of, last_quarter, target_end FROM lastpub JOIN quarters ON target_end > last_quarter AND target_end <= last_day(make_date(year(as_of), quarter(as_of) * 3, 1))),
cal AS (SELECT *, year(target_end) || 'Q' || quarter(target_end) AS target_quarter,
   CAST((year(as_of) * 12 + month(as_of)) - (year(target_end) * 12 + month(target_end) - 2) + 1 AS INTEGER) AS horizon FROM flight)"""

_FACTS = """
running AS (SELECT date, count(*) OVER w AS n, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS std, value FROM target
  WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
based AS (SELECT c.*, r.n, r.mean, r.std, r.value AS last_value, y.value AS year_ago, t.value AS realised
  FROM cal c JOIN running r ON r.date = c.last_quarter
  LEFT JOIN target y ON last_day(CAST(y.date + INTERVAL 12 MONTH AS DATE)) = c.target_end LEFT JOIN target t ON t.date = c.target_end),
long AS (SELECT *, 'random_walk' AS method, last_value AS level FROM based UNION ALL SELECT *, 'mean', mean FROM based UNION ALL SELECT *, 'seasonal', year_ago FROM based),
facts AS (SELECT as_of, target_quarter, horizon, method, level AS nowcast_level, (level - mean) / nullif(std, 0) AS nowcast_z, realised, level - realised AS error,
   CASE WHEN year(as_of) < 1999 THEN '1996-06_1998-12' ELSE '1999-01_2001-07' END AS period FROM long WHERE level IS NOT NULL),
scored AS (SELECT * FROM facts WHERE realised IS NOT NULL)"""

_WEIGHTS = """
pair AS (SELECT date, max(CASE WHEN series = 'order_value' THEN 5.0::DOUBLE / (4.0::DOUBLE + z * z) END) AS w_true, max(CASE WHEN series = 'order_count' THEN 5.0::DOUBLE / (4.0::DOUBLE + z * z) END) AS w_hat
  FROM zpanel WHERE z IS NOT NULL AND series IN ('order_value', 'order_count') GROUP BY date),
weights AS (SELECT 'orders' AS key, date, round(w_true, 9) AS w_true, round(w_hat, 9) AS w_hat, w_true < 0.8 AS contaminated FROM pair WHERE w_true IS NOT NULL AND w_hat IS NOT NULL),
nth AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY date) AS nth FROM weights),
late AS (SELECT * FROM nth WHERE nth > 1)"""

_STEPS = {
    "levels": [_REGISTRY, _LEVELS],
    "target": [_TARGET],
    "coded": [_REGISTRY, _LEVELS, _CODED],
    "panel": [_REGISTRY, _LEVELS, _TARGET, _CODED, _PANEL],
    "z": [_REGISTRY, _LEVELS, _TARGET, _CODED, _PANEL, _Z],
    "factors": [_REGISTRY, _LEVELS, _TARGET, _CODED, _PANEL, _Z, _FACTORS],
    "weights": [_REGISTRY, _LEVELS, _TARGET, _CODED, _PANEL, _Z, _WEIGHTS],
    "calendar": [_TARGET, _CALENDAR],
    "facts": [_TARGET, _CALENDAR, _FACTS],
}


def sql(step: str, select: str, *more: str, recursive: bool = False) -> str:
    """select under the common table expressions of a step and `more`."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join([*_STEPS[step], *more]) + "\n" + select


def r(x: str, name: str) -> str:
    """A rounded double, as `rounded` gives it."""
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0::DOUBLE AS {name}"
