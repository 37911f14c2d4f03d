"""The EM algorithm's sums as relations over rows of smoothed moments, for many fits at once.

rows: (fit, series, block, date, y, f, v): a series' value, and the mean and
variance of its factor at the date. Each step is one aggregation keyed by fit, so
moments of many fits that are stored as tables are updated together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matrices as X
from ..functions.special import digamma_column

#: Between which the degrees of freedom are sought: variances exist, and beyond is as good as Gaussian.
NU_LOW, NU_HIGH = 2.001, 1000.0


def observation_distances(rows: DataFrame, loadings: DataFrame) -> DataFrame:
    """(fit, date, m, d): observed series and their expected squared errors over noise. loadings: (fit, series, loading, noise)."""
    joined = rows.filter("y IS NOT NULL").join(loadings, ["fit", "series"])
    error = F.col("y") - F.col("loading") * F.col("f")
    term = (error * error + F.col("loading") * F.col("loading") * F.col("v")) / F.col("noise")
    return joined.groupBy("fit", "date").agg(F.count(F.lit(1)).alias("m"), F.sum(term).alias("d"))


def scale_weights(distances: DataFrame, nu: float) -> DataFrame:
    """distances with w = (nu + m) / (nu + d): small where errors are large."""
    return distances.withColumn("w", (F.lit(nu) + F.col("m")) / (F.lit(nu) + F.col("d")))


def shock_distances(factors: DataFrame, decay: float, shock: float) -> DataFrame:
    """(fit, block, date, d): squared innovations of each block's factor over the shock variance; null at its first date."""
    before = F.lag("f").over(Window.partitionBy("fit", "block").orderBy("date"))
    u = F.col("f") - F.lit(decay) * before
    return factors.select("fit", "block", "date", (u * u / F.lit(shock)).alias("d"))


def updated_loadings(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(fit, series, loading, noise): weighted least squares on expected moments; a series without values has 0 and 1."""
    joined = rows.join(weights.select("fit", "date", "w"), ["fit", "date"])
    seen = F.col("y").isNotNull()
    w = F.when(seen, F.col("w"))
    second = F.col("f") * F.col("f") + F.col("v")
    top, bottom = F.sum(w * F.col("y") * F.col("f")), F.sum(w * second)
    squares = F.sum(w * F.col("y") * F.col("y"))
    table = joined.groupBy("fit", "series").agg(F.count("y").alias("n"), top.alias("top"), bottom.alias("bottom"), squares.alias("squares"))
    loading = F.when(F.col("n") > 0, F.col("top") / F.nullif(F.col("bottom"), F.lit(0.0))).otherwise(0.0)
    table = table.withColumn("loading", loading)
    # sum of w ((y - l f)^2 + l^2 v) = squares - 2 l top + l^2 bottom
    noise = (F.col("squares") - 2 * F.col("loading") * F.col("top") + F.col("loading") * F.col("loading") * F.col("bottom")) / F.col("n")
    return table.select("fit", "series", "loading", F.when(F.col("n") > 0, noise).otherwise(1.0).alias("noise"))


def transition_moments(factors: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(fit, row, col, p11, p10, p00, n): sums of products of blocks' factors, now with now, now with before, before with before, and their number.

    weights (fit, date, w): each transition counts w of its later date, as the sums of
    Student-t shocks do; without them each counts one.
    """
    blocks = factors.groupBy("fit", "date").agg(F.map_from_entries(F.collect_list(F.struct("block", "f"))).alias("f"))
    before = F.lag("f").over(Window.partitionBy("fit").orderBy("date"))
    both = blocks.withColumn("g", before).filter("g IS NOT NULL")
    both = both.withColumn("w", F.lit(1.0)) if weights is None else both.join(weights.select("fit", "date", "w"), ["fit", "date"])
    known = F.array_intersect(F.map_keys("f"), F.map_keys("g"))  # a block that starts later has no moments before
    rows = both.select("fit", "w", "f", "g", known.alias("known")).select("*", F.explode("known").alias("row")).select("*", F.explode("known").alias("col"))
    at = lambda m, k: F.element_at(F.col(m), F.col(k))
    product = lambda x, i, y, j: F.sum(F.col("w") * at(x, i) * at(y, j))
    return rows.groupBy("fit", "row", "col").agg(
        product("f", "row", "f", "col").alias("p11"), product("f", "row", "g", "col").alias("p10"), product("g", "row", "g", "col").alias("p00"), F.count(F.lit(1)).alias("n")
    )


def matrices_of(cells: DataFrame, keys: list[str], row: str, col: str, values: list[str]) -> DataFrame:
    """keys, names (the rows' names in order) and for each of values a square matrix over them; cells that lack are 0."""
    entries = [F.collect_list(F.struct(F.col(col), F.col(v))).alias(v) for v in values]
    rows = cells.groupBy(*keys, F.col(row).alias("_row")).agg(*entries)
    whole = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_row", *values))).alias("_rows"))
    named = whole.withColumn("names", F.transform("_rows", lambda r: r["_row"]))
    row_of = lambda own: F.transform("names", lambda n: F.coalesce(F.element_at(own, n), F.lit(0.0)))
    matrix = lambda v: F.transform("_rows", lambda r: X.bound(F.map_from_entries(r[v]), row_of)).alias(v)
    return named.select(*keys, "names", *[matrix(v) for v in values])


def transition_update(moments: DataFrame) -> DataFrame:
    """(fit, names, a, q): the transition matrix P10 P00^-1 and the shocks' covariance (P11 - A P10') / n, made symmetric, of many fits at once.

    From the rows of transition_moments. A fit whose P00 is singular has null matrices.
    """
    n = moments.groupBy("fit").agg(F.max("n").alias("n"))
    m = matrices_of(moments, ["fit"], "row", "col", ["p11", "p10", "p00"]).join(n, "fit")
    # A P00 = P10 is P00' A' = P10', and P00 is symmetric
    m = m.withColumn("a", X.transposed(X.solve(F.col("p00"), X.transposed(F.col("p10")))))
    q = X.scaled(X.plus(F.col("p11"), X.product(F.col("a"), X.transposed(F.col("p10"))), -1.0), 1 / F.col("n"))
    return m.withColumn("q", q).select("fit", "names", "a", X.scaled(X.plus(F.col("q"), X.transposed(F.col("q"))), F.lit(0.5)).alias("q"))


def matrix_rows(fits: DataFrame, columns: list[str]) -> DataFrame:
    """(fit, row, col, columns): a row for each cell of the named square matrices."""
    one = fits.select("fit", "names", *columns, F.posexplode("names").alias("i", "row")).select("*", F.posexplode("names").alias("j", "col"))
    return one.select("fit", "row", "col", *[F.col(c)[F.col("i")][F.col("j")].alias(c) for c in columns])


def in_unit_scale(fits: DataFrame, scales: DataFrame) -> DataFrame:
    """fits (fit, names, a, q) for factors that are divided by their scales (fit, block, scale): a change of basis by a diagonal matrix."""
    own = scales.groupBy("fit").agg(F.map_from_entries(F.collect_list(F.struct("block", "scale"))).alias("s"))
    diagonal = F.transform("names", lambda n, i: F.transform("names", lambda m, j: F.when(i == j, F.element_at("s", n)).otherwise(0.0)))
    joined = fits.join(own, "fit").withColumn("h", diagonal)
    return joined.select("fit", "names", X.changed_basis(F.col("a"), F.col("h")).alias("a"), X.changed_covariance(F.col("q"), F.col("h")).alias("q"))


def impulse_responses(fits: DataFrame, horizon: int = 30) -> DataFrame:
    """(fit, h, row, col, response): A^h, for h from 0 to the horizon, of fits (fit, names, a)."""
    start = F.array(X.identity(F.size("names")))
    powers = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, lambda made, _: F.concat(made, F.array(X.product(F.element_at(made, -1), F.col("a")))))
    each = fits.filter("a IS NOT NULL").select("fit", "names", F.posexplode(powers).alias("h", "response"))
    one = each.select("*", F.posexplode("names").alias("i", "row")).select("*", F.posexplode("names").alias("j", "col"))
    return one.select("fit", "h", "row", "col", F.col("response")[F.col("i")][F.col("j")].alias("response"))


def roots_of_three(fits: DataFrame, matrix: str = "a") -> DataFrame:
    """(fit, nth, re, im, modulus): the eigenvalues of a 3 x 3 matrix in closed form, those of greatest modulus first, then of greatest real and imaginary part.

    The characteristic polynomial x^3 - t x^2 + s x - d is solved by the cosine form
    if all roots are real, else by cube roots. Fits of another size have no rows.
    """
    m = lambda i, j: F.col(matrix)[i][j]
    minor = lambda i, j: m(i, i) * m(j, j) - m(i, j) * m(j, i)
    det = m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1)) - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0)) + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0))
    rows = fits.filter(F.size(matrix) == 3).select("fit", (m(0, 0) + m(1, 1) + m(2, 2)).alias("t"), (minor(0, 1) + minor(0, 2) + minor(1, 2)).alias("s"), det.alias("d"))
    # with x = y + t / 3: y^3 + p y + q = 0
    rows = rows.select("fit", (F.col("t") / 3).alias("c"), (F.col("s") - F.col("t") * F.col("t") / 3).alias("p"), (-2 * F.pow("t", F.lit(3)) / 27 + F.col("t") * F.col("s") / 3 - F.col("d")).alias("q"))
    rows = rows.withColumn("disc", F.col("q") * F.col("q") / 4 + F.pow("p", F.lit(3)) / 27)
    radius = 2 * F.sqrt(F.greatest(F.lit(0.0), -F.col("p") / 3))
    cosine = F.when(radius > 0, 3 * F.col("q") / (F.col("p") * radius)).otherwise(0.0)
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))) / 3
    root = lambda re, im: F.struct(re.alias("re"), im.alias("im"))
    real = [root(F.col("c") + radius * F.cos(angle - 2 * math.pi * k / 3), F.lit(0.0)) for k in range(3)]
    half, deep = -F.col("q") / 2, F.sqrt(F.greatest(F.lit(0.0), F.col("disc")))
    u, v = F.cbrt(half + deep), F.cbrt(half - deep)
    width = (u - v) * (math.sqrt(3) / 2)
    mixed = [root(F.col("c") + u + v, F.lit(0.0)), root(F.col("c") - (u + v) / 2, width), root(F.col("c") - (u + v) / 2, -width)]
    found = F.when(F.col("disc") <= 0, F.array(*real)).otherwise(F.array(*mixed))
    order = F.array_sort(F.transform(found, lambda r: F.struct((-F.hypot(r["re"], r["im"])).alias("size"), (-r["re"]).alias("x"), (-r["im"]).alias("y"))))
    each = rows.select("fit", F.posexplode(order).alias("place", "r"))
    return each.select("fit", (F.col("place") + 1).alias("nth"), (-F.col("r.x")).alias("re"), (-F.col("r.y")).alias("im"), (-F.col("r.size")).alias("modulus"))


def degrees_condition(weights: DataFrame) -> DataFrame:
    """(fit, gap): 1 + mean log w - mean w, what the degrees of freedom's first-order condition adds to log(nu/2) - digamma(nu/2)."""
    return weights.groupBy("fit").agg((1 + F.avg(F.log("w")) - F.avg("w")).alias("gap"))


def degrees_of_freedom(weights: DataFrame, low: float = NU_LOW, high: float = NU_HIGH, halvings: int = 60) -> DataFrame:
    """(fit, gap, nu): the root of log(nu/2) - digamma(nu/2) + gap, which falls with nu, by bisection between the bounds; a root beyond a bound is the bound."""
    value = lambda nu: F.log(nu / 2) - digamma_column(nu / 2) + F.col("gap")
    between = F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        above = value(middle) > 0
        return F.struct(F.when(above, middle).otherwise(s["low"]).alias("low"), F.when(above, s["high"]).otherwise(middle).alias("high"))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), between, halve, lambda s: (s["low"] + s["high"]) / 2)
    return degrees_condition(weights).withColumn("nu", F.when(value(F.lit(low)) <= 0, low).when(value(F.lit(high)) >= 0, high).otherwise(root))


def block_components(gram: DataFrame) -> DataFrame:
    """(block, series, loading, value): each block's first principal component from gram (block, a, b, gram); the loadings' sum isn't negative, their length is one."""
    both = gram.select("block", "a", "b", "gram").unionByName(gram.filter("a <> b").select("block", F.col("b").alias("a"), F.col("a").alias("b"), "gram"))
    pair = matrices_of(both, ["block"], "a", "b", ["gram"]).select("block", "names", X.leading(F.col("gram")).alias("pair"))
    sign = F.when(F.aggregate("pair.vector", F.lit(0.0), lambda s, x: s + x) < 0, -1.0).otherwise(1.0)
    each = pair.select("block", "pair.value", F.explode(F.arrays_zip(F.col("names").alias("series"), F.col("pair.vector").alias("loading"))).alias("x"), sign.alias("sign"))
    return each.select("block", F.col("x.series").alias("series"), (F.col("x.loading") * F.col("sign")).alias("loading"), "value")


def component_factors(rows: DataFrame, components: DataFrame) -> DataFrame:
    """(block, date, factor): each date's values (series, date, z) times the loadings of their block's component; a date counts if all of a block's series have a value."""
    size = components.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    joined = rows.filter("z IS NOT NULL").join(components.select("block", "series", "loading"), ["block", "series"])
    sums = joined.groupBy("block", "date").agg(F.sum(F.col("z") * F.col("loading")).alias("factor"), F.count(F.lit(1)).alias("n"))
    return sums.join(size, "block").filter("n = size").select("block", "date", "factor")


def oriented(loadings: DataFrame, references: DataFrame) -> DataFrame:
    """loadings (fit, block, series, loading) with each block's sign turned so that its reference series (block, reference) is not negative."""
    known = loadings.join(references, "block")
    own = F.max(F.when(F.col("series") == F.col("reference"), F.col("loading"))).over(Window.partitionBy("fit", "block"))
    return known.withColumn("sign", F.when(own < 0, -1.0).otherwise(1.0)).withColumn("loading", F.col("loading") * F.col("sign")).drop("reference")


def unit_scale(factors: DataFrame) -> DataFrame:
    """(fit, block, scale): the root of a factor's total variance, between dates and within; dividing by it makes the total one."""
    return factors.groupBy("fit", "block").agg(F.sqrt(F.var_pop("f") + F.avg("v")).alias("scale"))


def bits(column: str) -> Column:
    """A double's shortest decimal form, which names its value."""
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def fingerprint(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys and the first 12 hexadecimal digits of SHA-1 over a group's values in order: equal data, equal name."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), bits(value).alias("b")))), lambda x: F.concat_ws("=", x["o"].cast("string"), x["b"])), ";")
    return rows.groupBy(*keys).agg(F.substring(F.sha1(line), 1, 12).alias("fingerprint"))
