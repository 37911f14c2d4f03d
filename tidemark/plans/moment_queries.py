"""Queries over the sums of the EM algorithm, with block means as stand-ins for smoothed factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import digamma_sql
from ..operators import moments as M
from ..operators import profile, recovery
from ..operators.static_em import fit_static
from ..sources import results
from . import base
from .base import r, sql

NU, V = 6.0, 0.05


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    z, factors = base.factors(spark, sf)
    joined = z.filter("freq = 'monthly'").join(factors, ["block", "date"])
    return joined.select(F.lit("a").alias("fit"), "series", "block", "date", F.col("z").alias("y"), F.col("factor").alias("f"), F.lit(V).alias("v"))


def _factors(spark: SparkSession, sf: str) -> DataFrame:
    _, factors = base.factors(spark, sf)
    return factors.select(F.lit("a").alias("fit"), "block", "date", F.col("factor").alias("f"), F.lit(V).alias("v"))


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    z, factors = base.factors(spark, sf)
    own = profile.loadings(z, factors).select(F.lit("a").alias("fit"), "series", "loading", F.col("residual_var").alias("noise"))
    return M.scale_weights(M.observation_distances(_rows(spark, sf), own), NU)


def em_weights(spark: SparkSession, sf: str):
    return _weights(spark, sf).select("date", "m", "d", "w")


def em_shock_distances(spark: SparkSession, sf: str):
    return M.shock_distances(_factors(spark, sf), 0.5, 0.8).select("block", "date", "d")


def em_loadings(spark: SparkSession, sf: str):
    return M.updated_loadings(_rows(spark, sf), _weights(spark, sf)).select("series", "loading", "noise")


def em_transition_moments(spark: SparkSession, sf: str):
    return M.transition_moments(_factors(spark, sf)).select("row", "col", "p11", "p10", "p00")


def em_degrees(spark: SparkSession, sf: str):
    return M.degrees_of_freedom(_weights(spark, sf)).select("gap", "nu")


def em_degrees_by_year(spark: SparkSession, sf: str):
    """Many roots at once: a fit is a year's weights."""
    return M.degrees_of_freedom(_weights(spark, sf).withColumn("fit", F.year("date"))).select("fit", "nu")


def _transitions(spark: SparkSession, sf: str) -> DataFrame:
    """A fit by all transitions, and one with each weighted by its date's weight."""
    factors, weights = _factors(spark, sf), _weights(spark, sf)
    plain = M.transition_moments(factors)
    weighted = M.transition_moments(factors, weights).withColumn("fit", F.lit("weighted"))
    return M.transition_update(plain.unionByName(weighted))


def em_transition(spark: SparkSession, sf: str):
    return M.matrix_rows(_transitions(spark, sf), ["a", "q"])


def impulse_responses(spark: SparkSession, sf: str):
    return M.impulse_responses(_transitions(spark, sf)).filter("row = col")


def transition_roots(spark: SparkSession, sf: str):
    return M.roots_of_three(_transitions(spark, sf)).select("fit", "nth", F.abs("re").alias("re"), F.abs("im").alias("im"), "modulus")


def basis_change(spark: SparkSession, sf: str):
    """The transition of factors that are scaled to a total variance of one."""
    scales = M.unit_scale(_factors(spark, sf))
    both = scales.unionByName(scales.withColumn("fit", F.lit("weighted")))
    return M.matrix_rows(M.in_unit_scale(_transitions(spark, sf), both), ["a", "q"])


def _correlations(spark: SparkSession, sf: str) -> DataFrame:
    """(fit, series, factor, hat, star): correlations of series with each block's factor until 1998, and over all dates."""
    z, factors = base.factors(spark, sf)
    rows = z.filter("freq = 'monthly' AND z IS NOT NULL").select("series", "date", "z").join(factors.withColumnRenamed("block", "f"), "date")
    early = F.when(F.col("date") < F.lit("1999-01-01").cast("date"), F.col("z"))
    return rows.groupBy("series", F.col("f").alias("factor")).agg(F.corr(early, "factor").alias("hat"), F.corr("z", "factor").alias("star")).withColumn("fit", F.lit("a"))


def procrustes_free(spark: SparkSession, sf: str):
    made = recovery.free_rotation(_correlations(spark, sf))
    return M.matrix_rows(made, ["rotation"]).join(made.select("fit", "error"), "fit")


def static_em(spark: SparkSession, sf: str):
    """One fit of all months, and one of each of two halves, from least-squares loadings on block means."""
    z, factors = base.factors(spark, sf)
    rows = z.filter("freq = 'monthly'").select("series", "block", "date", F.col("z").alias("y"))
    half = F.when(F.col("date") < F.lit("1998-07-01").cast("date"), "early").otherwise("late")
    rows = rows.withColumn("fit", F.lit("all")).unionByName(rows.withColumn("fit", half))
    start = profile.loadings(z, factors).select("series", "loading", F.greatest("residual_var", F.lit(0.01)).alias("noise"))
    start = rows.select("fit", "series").distinct().join(start, "series")
    return fit_static(rows, start, tolerance=2e-3, max_iter=12)


def _block_gram(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    z = base.standardised(spark, sf).filter("freq = 'monthly'")
    blocks = z.select("series", "block").distinct()
    pairs = profile.gram(z).join(blocks.withColumnsRenamed({"series": "a"}), "a").join(blocks.select(F.col("series").alias("b"), F.col("block").alias("other")), "b")
    return z, pairs.filter("block = other")


def block_pca(spark: SparkSession, sf: str):
    return M.block_components(_block_gram(spark, sf)[1])


def pca_factors(spark: SparkSession, sf: str):
    z, gram = _block_gram(spark, sf)
    return M.component_factors(z, M.block_components(gram))


def em_orientation(spark: SparkSession, sf: str):
    z, factors = base.factors(spark, sf)
    own = profile.loadings(z, factors).select(F.lit("a").alias("fit"), "block", "series", "loading")
    references = spark.createDataFrame([("real", "shipped_qty"), ("financial", "avg_discount"), ("other", "unit_price")], "block string, reference string")
    return M.oriented(own, references).select("block", "series", "loading", "sign")


def em_unit_scale(spark: SparkSession, sf: str):
    return M.unit_scale(_factors(spark, sf)).select("block", "scale")


def data_fingerprint(spark: SparkSession, sf: str):
    rows = base.levels(spark, sf).select("series", "date", F.round(F.col("value") * 1000).cast("long").alias("value"))
    return M.fingerprint(rows, ["series"], "date", "value")


def scenario_names(spark: SparkSession, sf: str):
    rows = base.levels(spark, sf).groupBy("series").agg(F.count(F.lit(1)).cast("int").alias("months"))
    return rows.select("series", results.scenario_name(F.col("series"), F.col("months"), F.lit(0.05), F.lit(20)).alias("name"))


QUERIES = {f.__name__: f for f in (em_weights, em_shock_distances, em_loadings, em_transition_moments, em_transition, impulse_responses, transition_roots, basis_change, procrustes_free, static_em, block_pca, pca_factors, em_degrees, em_degrees_by_year, em_orientation, em_unit_scale, data_fingerprint, scenario_names)}

_NOISE = "own AS (SELECT series, loading, var_samp(residual) AS noise FROM fits GROUP BY series, loading)"
_ROWS = "mrows AS (SELECT z.series, z.block, z.date, z.z AS y, f.factor AS f, 0.05::DOUBLE AS v FROM zpanel z JOIN factors f ON f.block = z.block AND f.date = z.date WHERE z.freq = 'monthly')"
_W = "wts AS (SELECT date, count(*) AS m, sum(((y - loading * f) ** 2 + loading * loading * v) / noise) AS d FROM mrows JOIN own USING (series) WHERE y IS NOT NULL GROUP BY date), ww AS (SELECT *, (6.0::DOUBLE + m) / (6.0::DOUBLE + d) AS w FROM wts)"
_SUMS = "sums AS (SELECT series, count(y) AS n, sum(CASE WHEN y IS NOT NULL THEN w * y * f END) AS a, sum(CASE WHEN y IS NOT NULL THEN w * (f * f + v) END) AS b, sum(w * y * y) AS c FROM mrows JOIN ww USING (date) GROUP BY series)"
_G = lambda nu: f"(ln({nu} / 2) - {digamma_sql(f'({nu} / 2)')} + gap)"
_NU = r(f"CASE WHEN {_G('2.001::DOUBLE')} <= 0 THEN 2.001 WHEN {_G('1000.0::DOUBLE')} >= 0 THEN 1000 ELSE (lo + hi) / 2 END", "nu")


def _bisected(gaps: str, keys: str = "") -> list[str]:
    middle = "((lo + hi) / 2)"
    return [
        f"gaps AS ({gaps})",
        f"""bis AS (SELECT {keys}gap, 0 AS i, 2.001::DOUBLE AS lo, 1000.0::DOUBLE AS hi FROM gaps
           UNION ALL SELECT {keys}gap, i + 1, CASE WHEN {_G(middle)} > 0 THEN {middle} ELSE lo END, CASE WHEN {_G(middle)} > 0 THEN hi ELSE {middle} END FROM bis WHERE i < 60)""",
        "roots AS (SELECT * FROM bis WHERE i = 60)",
    ]


def _cell(m: str, i: int, j: int) -> str:
    return f"max({m}) FILTER (WHERE row = '{_BLOCKS[i]}' AND col = '{_BLOCKS[j]}') AS {m}_{i}{j}"


_BLOCKS = ("financial", "other", "real")
_NINE = [(i, j) for i in range(3) for j in range(3)]
_COF = {(i, j): f"(p00_{(i + 1) % 3}{(j + 1) % 3} * p00_{(i + 2) % 3}{(j + 2) % 3} - p00_{(i + 1) % 3}{(j + 2) % 3} * p00_{(i + 2) % 3}{(j + 1) % 3})" for i, j in _NINE}
_XCOF = {k: v.replace("p00_", "x_") for k, v in _COF.items()}
_XDET = f"(x_00 * {_XCOF[0, 0]} + x_01 * {_XCOF[0, 1]} + x_02 * {_XCOF[0, 2]})"
_TRANSITION = [
    "lagged AS (SELECT *, lag(factor) OVER (PARTITION BY block ORDER BY date) AS g FROM factors)",
    """tm AS (SELECT 'a' AS fit, x.block AS row, y.block AS col, sum(x.factor * y.factor) AS p11, sum(x.factor * y.g) AS p10, sum(x.g * y.g) AS p00, count(*) AS n
        FROM lagged x JOIN lagged y ON x.date = y.date WHERE x.g IS NOT NULL AND y.g IS NOT NULL GROUP BY ALL
      UNION ALL SELECT 'weighted', x.block, y.block, sum(w * x.factor * y.factor), sum(w * x.factor * y.g), sum(w * x.g * y.g), count(*)
        FROM lagged x JOIN lagged y ON x.date = y.date JOIN ww ON ww.date = x.date WHERE x.g IS NOT NULL AND y.g IS NOT NULL GROUP BY ALL)""",
    "flat AS (SELECT fit, max(n) AS n, " + ", ".join(_cell(m, i, j) for m in ("p11", "p10", "p00") for i, j in _NINE) + " FROM tm GROUP BY fit)",
    f"det AS (SELECT *, p00_00 * {_COF[0, 0]} + p00_01 * {_COF[0, 1]} + p00_02 * {_COF[0, 2]} AS d FROM flat)",
    # the inverse of P00 is its cofactors, transposed, over the determinant
    "amat AS (SELECT *, " + ", ".join(f"({' + '.join(f'p10_{i}{k} * {_COF[j, k]}' for k in range(3))}) / d AS a_{i}{j}" for i, j in _NINE) + " FROM det)",
    "qmat AS (SELECT *, " + ", ".join(f"(p11_{i}{j} - ({' + '.join(f'a_{i}{k} * p10_{j}{k}' for k in range(3))})) / n AS q_{i}{j}" for i, j in _NINE) + " FROM amat)",
    "cells AS (" + " UNION ALL ".join(f"SELECT fit, '{_BLOCKS[i]}' AS row, '{_BLOCKS[j]}' AS col, a_{i}{j} AS a, (q_{i}{j} + q_{j}{i}) / 2 AS q FROM qmat" for i, j in _NINE) + ")",
]
_POWERS = (
    "powers AS (SELECT fit, 0 AS h, [" + ", ".join("[" + ", ".join(f"a_{i}{j}" for j in range(3)) + "]" for i in range(3)) + "] AS a, [[1.0::DOUBLE, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]] AS m FROM amat "
    "UNION ALL SELECT fit, h + 1, a, list_transform(m, lambda u: list_transform([1, 2, 3], lambda j: u[1] * a[1][j] + u[2] * a[2][j] + u[3] * a[3][j])) FROM powers WHERE h < 30)"
)
_PCA = [
    "mz AS (SELECT * FROM zpanel WHERE freq = 'monthly' AND z IS NOT NULL)",
    "g0 AS (SELECT x.block, x.series AS a, y.series AS b, sum(x.z * y.z) / (SELECT count(DISTINCT date) FROM mz) AS g FROM mz x JOIN mz y ON x.date = y.date AND x.block = y.block GROUP BY ALL)",
    "g1 AS (SELECT block, a, list(g ORDER BY b) AS row FROM g0 GROUP BY block, a)",
    "g2 AS (SELECT block, list(a ORDER BY a) AS names, list(row ORDER BY a) AS m FROM g1 GROUP BY block)",
    """pw AS (SELECT block, names, m, 0 AS i, list_transform(names, lambda n, k: 1.0::DOUBLE + k / 10.0::DOUBLE) AS v FROM g2
       UNION ALL SELECT block, names, m, i + 1, list_transform(m, lambda u: list_dot_product(u, v) / sqrt(list_sum(list_transform(m, lambda t: list_dot_product(t, v) ** 2)))) FROM pw WHERE i < 3000)""",
    "pcs AS (SELECT block, names, v, list_sum(list_transform(m, lambda u, i: v[i] * list_dot_product(u, v))) AS value FROM pw WHERE i = 3000)",
]

SQL = {
    "em_weights": sql("factors", f"SELECT date, m, {r('d', 'd')}, {r('w', 'w')} FROM ww", _NOISE, _ROWS, _W),
    "em_shock_distances": sql("factors", f"SELECT block, date, {r('(factor - 0.5 * lag(factor) OVER (PARTITION BY block ORDER BY date)) ** 2 / 0.8', 'd')} FROM factors"),
    "em_loadings": sql("factors", f"SELECT series, {r('a / b', 'loading')}, {r('(c - 2 * a / b * a + (a / b) * (a / b) * b) / n', 'noise')} FROM sums", _NOISE, _ROWS, _W, _SUMS),
    "em_transition_moments": sql(
        "factors",
        f"SELECT x.block AS row, y.block AS col, {r('sum(x.factor * y.factor)', 'p11')}, {r('sum(x.factor * y.g)', 'p10')}, {r('sum(x.g * y.g)', 'p00')} FROM lagged x JOIN lagged y ON x.date = y.date WHERE x.g IS NOT NULL AND y.g IS NOT NULL GROUP BY ALL",
        "lagged AS (SELECT *, lag(factor) OVER (PARTITION BY block ORDER BY date) AS g FROM factors)",
    ),
    "em_degrees": sql("factors", f"SELECT {r('gap', 'gap')}, {_NU} FROM roots", _NOISE, _ROWS, _W, *_bisected("SELECT 1 + avg(ln(w)) - avg(w) AS gap FROM ww"), recursive=True),
    "em_degrees_by_year": sql("factors", f"SELECT fit, {_NU} FROM roots", _NOISE, _ROWS, _W, *_bisected("SELECT CAST(year(date) AS INTEGER) AS fit, 1 + avg(ln(w)) - avg(w) AS gap FROM ww GROUP BY 1", "fit, "), recursive=True),
    "em_transition": sql("factors", f"SELECT fit, row, col, {r('a', 'a')}, {r('q', 'q')} FROM cells", _NOISE, _ROWS, _W, *_TRANSITION),
    "impulse_responses": sql("factors", f"SELECT fit, CAST(h AS INTEGER) AS h, b.name AS row, b.name AS col, {r('m[k][k]', 'response')} FROM powers CROSS JOIN (VALUES (1, 'financial'), (2, 'other'), (3, 'real')) b(k, name)", _NOISE, _ROWS, _W, *_TRANSITION, _POWERS, recursive=True),
    "basis_change": sql(
        "factors",
        f"SELECT fit, row, col, {r('a * y.scale / x.scale', 'a')}, {r('q / x.scale / y.scale', 'q')} FROM cells JOIN sc x ON x.block = row JOIN sc y ON y.block = col",
        _NOISE, _ROWS, _W, *_TRANSITION, "sc AS (SELECT block, sqrt(var_pop(factor) + 0.05) AS scale FROM factors GROUP BY block)",
    ),
    "procrustes_free": sql(
        "factors",
        f"SELECT 'a' AS fit, row, col, {r('rotation', 'rotation')}, {r('sqrt(greatest(0, h2 - 2 * (' + ' + '.join(f'x_{i}{j} * c_{i}{j}' for i, j in _NINE) + ') + s2)) / sqrt(s2)', 'error')} FROM (SELECT *, unnest([" + ", ".join(f"{{'row': '{_BLOCKS[i]}', 'col': '{_BLOCKS[j]}', 'rotation': x_{i}{j}}}" for i, j in _NINE) + "], recursive := true) FROM newton WHERE k = 60)",
        "co AS (SELECT series, f.block AS f, corr(z, factor) FILTER (WHERE z.date < DATE '1999-01-01') AS hat, corr(z, factor) AS star FROM zpanel z JOIN factors f ON f.date = z.date WHERE z.freq = 'monthly' AND z.z IS NOT NULL GROUP BY ALL)",
        "crossed AS (SELECT x.f AS i, y.f AS j, sum(x.hat * y.star) AS c FROM co x JOIN co y ON x.series = y.series GROUP BY ALL)",
        "mm AS (SELECT " + ", ".join(f"max(c) FILTER (WHERE i = '{_BLOCKS[i]}' AND j = '{_BLOCKS[j]}') AS c_{i}{j}" for i, j in _NINE) + ", (SELECT sum(hat * hat) FROM co) AS h2, (SELECT sum(star * star) FROM co) AS s2 FROM crossed)",
        # the transposed inverse is the cofactors over the determinant
        "newton AS (SELECT 0 AS k, mm.*, " + ", ".join(f"c_{i}{j} AS x_{i}{j}" for i, j in _NINE) + " FROM mm UNION ALL SELECT k + 1, " + ", ".join(f"c_{i}{j}" for i, j in _NINE) + ", h2, s2, " + ", ".join(f"(x_{i}{j} + {_XCOF[i, j]} / {_XDET}) / 2" for i, j in _NINE) + " FROM newton WHERE k < 60)",
        recursive=True,
    ),
    "block_pca": sql("z", f"SELECT block, s.series AS series, {r('s.x * CASE WHEN list_sum(v) < 0 THEN -1 ELSE 1 END', 'loading')}, {r('value', 'value')} FROM (SELECT block, v, value, unnest(list_transform(names, lambda n, i: {{'series': n, 'x': v[i]}})) AS s FROM pcs)", *_PCA, recursive=True),
    "pca_factors": sql(
        "z",
        f"SELECT block, date, {r('sum(z * x)', 'factor')} FROM zpanel JOIN (SELECT block AS blk, len(names) AS size, s.series AS name, s.x * CASE WHEN list_sum(v) < 0 THEN -1 ELSE 1 END AS x FROM (SELECT block, v, names, unnest(list_transform(names, lambda n, i: {{'series': n, 'x': v[i]}})) AS s FROM pcs)) c ON c.name = series WHERE z IS NOT NULL GROUP BY block, date, size HAVING count(*) = size",
        *_PCA, recursive=True,
    ),
    "em_orientation": sql(
        "factors",
        f"SELECT l.block, l.series, {r('l.loading * s.sign', 'loading')}, {r('s.sign', 'sign')} FROM loads l JOIN (SELECT block, CASE WHEN loading < 0 THEN -1.0 ELSE 1.0 END AS sign FROM loads WHERE series IN ('shipped_qty', 'avg_discount', 'unit_price')) s ON s.block = l.block",
    ),
    "em_unit_scale": sql("factors", f"SELECT block, {r('sqrt(var_pop(factor) + 0.05)', 'scale')} FROM factors GROUP BY block"),
    "data_fingerprint": sql("levels", "SELECT series, left(sha1(string_agg(CAST(date AS VARCHAR) || '=' || CAST(CAST(round(value * 1000) AS BIGINT) AS VARCHAR), ';' ORDER BY date)), 12) AS fingerprint FROM levels GROUP BY series"),
    "scenario_names": sql("levels", "SELECT series, format('mc_{}_T{:04d}_pi0.05_S20.json', series, count(*)) AS name FROM levels GROUP BY series"),
}
