"""Small dense matrices as array columns: a row of a table holds a whole system, so many are solved at once.

A matrix is array<array<double>>, a vector array<double>. Sizes are those of a
model's blocks or predictors, a few dozen at most; rows are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def product(a: Column, b: Column) -> Column:
    """a times b; the rows of b are met by the entries of a's rows."""
    return bound(transposed(b), lambda t: F.transform(a, lambda row: F.transform(t, lambda column: dot(row, column))))


def times(a: Column, x: Column) -> Column:
    return F.transform(a, lambda row: dot(row, x))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, z: s + z)


def transposed(a: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(a[0]) - 1), lambda j: F.transform(a, lambda row: F.get(row, j)))


def plus(a: Column, b: Column, times_b: float | Column = 1.0) -> Column:
    """a + times_b * b."""
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda u, v: u + v * times_b))


def scaled(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda row: F.transform(row, lambda x: x * factor))


def identity(n: Column) -> Column:
    places = F.sequence(F.lit(0), n - 1)
    return F.transform(places, lambda i: F.transform(places, lambda j: F.when(i == j, 1.0).otherwise(0.0)))


def solve(a: Column, b: Column) -> Column:
    """x of a x = b for matrices b, by elimination with the largest pivot of each column; null for a singular a or one with nulls.

    A pivot counts as zero below 1e-13 of the largest entry of a. Each step keeps
    one augmented matrix, which the next one replaces.
    """
    n = F.size(a)
    joined = F.zip_with(a, b, lambda x, y: F.concat(x, y))
    most = F.array_max(F.transform(a, lambda row: F.array_max(F.transform(row, F.abs))))
    known = ~F.exists(a, lambda row: row.isNull() | F.exists(row, lambda x: x.isNull() | F.isnan(x)))
    empty = F.lit(None).cast("array<array<double>>")

    def step(m: Column, k: Column) -> Column:
        rows = F.sequence(k, n - 1)
        best = F.array_max(F.transform(rows, lambda i: F.struct(F.abs(m[i][k]).alias("size"), (-i).alias("place"))))

        def eliminated(best: Column) -> Column:
            at = -best["place"]
            own = F.transform(m[at], lambda x: x / m[at][k])

            def cleared(pivot: Column) -> Column:
                def one(row: Column, i: Column) -> Column:
                    source = F.when(i == at, m[k]).otherwise(row)  # rows k and at change places
                    return F.when(i == k, pivot).otherwise(bound(source, lambda r: F.zip_with(r, pivot, lambda x, p: x - r[k] * p)))

                return F.transform(m, one)

            return F.when(best["size"] > most * 1e-13, bound(own, cleared)).otherwise(empty)

        return F.when(m.isNotNull(), bound(best, eliminated)).otherwise(empty)

    done = F.aggregate(F.sequence(F.lit(0), n - 1), F.when(known, joined).otherwise(empty), step)
    return F.transform(done, lambda row: F.slice(row, n + 1, F.size(row) - n))


def inverse(a: Column) -> Column:
    return solve(a, identity(F.size(a)))


def solve_vector(a: Column, b: Column) -> Column:
    return F.transform(solve(a, F.transform(b, lambda x: F.array(x))), lambda row: row[0])


def length(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def leading(a: Column, squarings: int = 40) -> Column:
    """(value, vector) of the largest eigenvalue of a symmetric matrix without negative eigenvalues; its length is one.

    The matrix is squared and scaled again and again, which doubles the number of
    power steps each time; then any column that isn't zero is the vector. Eigenvalues
    closer than a 2 ** -squarings share are not told apart. A zero matrix has
    value 0 and the first unit vector.
    """
    biggest = lambda m: F.array_max(F.transform(m, lambda row: F.array_max(F.transform(row, F.abs))))
    unit = lambda m: bound(biggest(m), lambda s: F.when(s > 0, scaled(m, 1 / s)).otherwise(identity(F.size(m))))
    power = F.aggregate(F.sequence(F.lit(1), F.lit(squarings)), unit(a), lambda m, _: bound(product(m, m), unit))
    sizes = lambda m: F.transform(m, lambda row, i: F.struct(length(row).alias("size"), (-i).alias("place"), row.alias("row")))
    vector = bound(F.array_max(sizes(power)), lambda best: F.transform(best["row"], lambda x: x / best["size"]))
    return bound(vector, lambda v: F.struct(dot(v, times(a, v)).alias("value"), v.alias("vector")))


def deflated(a: Column, pair: Column) -> Column:
    """a without the part along an eigenvector, given as leading gives it."""
    return F.transform(a, lambda row, i: F.zip_with(row, pair["vector"], lambda x, v: x - pair["value"] * pair["vector"][i] * v))


def polar(a: Column, rounds: int = 60) -> Column:
    """The orthogonal matrix nearest a regular one, by Newton's iteration: the mean of a matrix and its transposed inverse, again and again; null for a singular one."""
    empty = F.lit(None).cast("array<array<double>>")
    step = lambda m, _: F.when(m.isNotNull(), scaled(plus(m, transposed(inverse(m))), F.lit(0.5))).otherwise(empty)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), a, step)


def changed_basis(a: Column, h: Column) -> Column:
    """h^-1 a h: what a is for coordinates in the columns of h."""
    return solve(h, product(a, h))


def changed_covariance(q: Column, h: Column) -> Column:
    """h^-1 q h'^-1: the covariance of coordinates in the columns of h."""
    return transposed(solve(h, transposed(solve(h, q))))
