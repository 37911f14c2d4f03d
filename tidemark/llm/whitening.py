"""Whitening of embeddings by cyclic Jacobi rotations.

Entries are put on a grid of whole numbers, so that sums are exact. Tasks add up
the centred scatter of their rows; the driver turns it into a diagonal matrix by
Jacobi rotations, sweep after sweep over all pairs, until every off-diagonal entry
is negligible next to the two diagonal ones it stands between. That test is
relative, so small eigenvalues come out as accurate as large ones. The rows are
then projected by the sorted eigenvectors over the roots of the eigenvalues.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

COMPONENTS = 32
#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Off-diagonal entries count as zero at this size, relative to the root of the product of their diagonal entries.
NEGLIGIBLE, MAX_SWEEPS = 1e-15, 60
#: Eigenvalues up to this share of the trace are zero but for rounding: such a direction has no variance to scale.
VANISHING = 1e-13
_LONG = 2**63 - 1


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns) of a symmetric matrix; each vector's entry of largest size is positive."""
    a = np.array(matrix, float)
    n = len(a)
    v = np.eye(n)
    for _ in range(MAX_SWEEPS):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                if a[p, q] == 0.0 or abs(a[p, q]) <= NEGLIGIBLE * np.sqrt(abs(a[p, p] * a[q, q])):
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s, shift = t * c, t * a[p, q]
                x, y = a[p].copy(), a[q].copy()
                a[p], a[q] = c * x - s * y, s * x + c * y
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q], a[p, q], a[q, p] = x[p] - shift, y[q] + shift, 0.0, 0.0
                x = v[:, p].copy()
                v[:, p], v[:, q] = c * x - s * v[:, q], s * x + c * v[:, q]
        if not turned:
            break
    values = np.diag(a).copy()
    falling = np.argsort(-values, kind="stable")
    v = v[:, falling]
    v *= np.where(v[np.abs(v).argmax(axis=0), np.arange(n)] < 0, -1.0, 1.0) if n else 1.0
    return values[falling], v


def _whole(batch: pa.RecordBatch, dims: int | None, scale: float, shift: int):
    """For each length of vectors (or dims alone): (places in the batch, whole numbers, a row for each vector that is finite throughout)."""
    column = batch.column(1)
    length = np.asarray(column.value_lengths().fill_null(0))
    for d in np.unique(length) if dims is None else [dims]:
        at = np.flatnonzero(length == d)
        if not d or not len(at):
            continue
        values = column.take(pa.array(at)).flatten().cast(pa.float64())
        c = values.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, d)
        fine = np.isfinite(c).all(axis=1)
        if not fine.any():
            continue
        # beyond the range of a long, entries stand at its ends
        grid = np.clip(np.floor(scale * c[fine]), -(2.0**62), 2.0**62).astype(np.int64) + shift
        yield at[fine], grid


def _exact(x: np.ndarray, least: int) -> np.ndarray:
    """x as it is, or as Python's integers if sums of `least` times its size could leave a long."""
    size = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    return x if size * least <= _LONG else x.astype(object)


@dataclass
class Whitening:
    """n rows with exact sums; the eigenvalues that fall, the projection (a column for each component) and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    projection: np.ndarray
    trace: float
    scale: float = SCALE
    shift: int = SHIFT

    @property
    def dims(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less its mean: the mean's whole part is taken off exactly, the rest in doubles."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(float) - part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - sum) ** 2, exact; null beyond the range of a long."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        y = _exact(_exact(x - whole, self.n + 1) * self.n - rest, 1)
        size = max((abs(int(z)) for z in (y.max(initial=0), y.min(initial=0))), default=0)
        found = (y * y).sum(axis=1) if size * size * max(1, self.dims) <= _LONG else (y.astype(object) ** 2).sum(axis=1)
        return [int(f) if f <= _LONG else None for f in found]


def _rows(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    return vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))


def _summed(parts: DataFrame) -> dict[int, float]:
    return dict(map(tuple, parts.groupBy("cell").agg(F.sum("value").alias("value")).collect()))


def _scatter(rows: DataFrame, dims: int, width: int, points) -> tuple[np.ndarray, np.ndarray]:
    """(sums, sums of products) of width columns that points(whole numbers) gives; a task hands on one value for each cell of them."""
    upper = np.triu_indices(width)

    def run(batches):
        total, products = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            for x in points(batch):
                total += x.sum(axis=0)
                products += x.T @ x
        value = np.r_[total, products[upper]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value)), pa.int32()), pa.array(value)], ["cell", "value"])

    found = _summed(rows.mapInArrow(run, "cell int, value double"))
    value = np.array([found.get(k, 0.0) for k in range(width + len(upper[0]))])
    products = np.zeros((width, width))
    products[upper] = value[width:]
    return value[:width], products + np.triu(products, 1).T


def fit(vectors: DataFrame, components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT, id_column: str = "vec_id", vector_column: str = "embedding") -> Whitening | None:
    """The whitening of all rows whose vector is finite throughout; None if there are no such rows.

    Vectors have the length that most of them have, the greater of two such; those
    of another length are left out. Directions without variance are no components,
    so there may be fewer than asked for. The driver holds the square of a vector's
    length.
    """
    rows = _rows(vectors, id_column, vector_column)

    def count(batches):
        seen: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for _, x in _whole(batch, None, scale, shift):
                n, sums = seen.get(x.shape[1], (0, [0] * x.shape[1]))
                own = _exact(x, len(x) + 1).sum(axis=0)
                seen[x.shape[1]] = n + len(x), [a + int(b) for a, b in zip(sums, own, strict=True)]
        made = [(d, i, n if i < 0 else sums[i]) for d, (n, sums) in seen.items() for i in range(-1, d)]
        columns = [pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.int32()), pa.array([Decimal(m[2]) for m in made], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(columns, ["length", "place", "value"])

    counted = rows.mapInArrow(count, "length int, place int, value decimal(38,0)").groupBy("length", "place").agg(F.sum("value").cast("decimal(38,0)").alias("value"))
    counted = materialise(counted, "sums")
    sizes = counted.filter("place = -1").orderBy(F.desc("value"), F.desc("length")).limit(1).collect()
    if not sizes:
        return None
    n, dims = int(sizes[0]["value"]), sizes[0]["length"]
    found = {r["place"]: int(r["value"]) for r in counted.filter((F.col("length") == dims) & (F.col("place") >= 0)).collect()}
    model = Whitening(n, [found[i] for i in range(dims)], np.zeros(0), np.zeros((dims, 0)), 0.0, scale, shift)

    def centred(batch):
        return (model.centred(x) for _, x in _whole(batch, dims, scale, shift))

    total, products = _scatter(rows, dims, dims, centred)
    covariance = products / n - np.outer(total / n, total / n)  # the totals are zero but for rounding
    model.values, axes = jacobi(covariance)
    model.trace = float(np.trace(covariance))
    kept = min(components, int((model.values > VANISHING * model.trace).sum()))
    model.projection = axes[:, :kept] / np.sqrt(model.values[:kept])
    return model


def identity_error(vectors: DataFrame, model: Whitening, id_column: str = "vec_id", vector_column: str = "embedding") -> float:
    """The largest absolute entry of the covariance of the whitened rows less the identity, measured over all rows."""
    width = model.projection.shape[1]
    if not width:
        return 0.0

    def whitened(batch):
        return (model.centred(x) @ model.projection for _, x in _whole(batch, model.dims, model.scale, model.shift))

    total, products = _scatter(_rows(vectors, id_column, vector_column), model.dims, width, whitened)
    covariance = products / model.n - np.outer(total / model.n, total / model.n)
    return float(np.abs(covariance - np.eye(width)).max())


def apply(vectors: DataFrame, model: Whitening | None, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, deviation, whitened array<double>) for each row whose vector is finite and of the model's length; others go.

    Repeated rows and null ids stay as they are; without a model there are no rows.
    Other columns are ignored, so their names cannot clash.
    """
    rows = _rows(vectors, id_column, vector_column)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long, whitened array<double>"

    def run(batches):
        for batch in batches:
            for at, x in _whole(batch, model.dims, model.scale, model.shift):
                made = model.centred(x) @ model.projection
                ends = pa.array(np.arange(len(x) + 1) * made.shape[1], pa.int32())
                whitened = pa.ListArray.from_arrays(ends, pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(model.deviations(x), pa.int64()), whitened], ["vec_id", "deviation", "whitened"])

    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(run, schema)


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """A row for each remaining row and component, numbered from 1: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, holds null or values that aren't finite, or has
    another length than most, are left out. Empty tables, and tables of equal
    vectors, give no rows.
    """
    model = fit(vectors, components, id_column=id_column, vector_column=vector_column)
    rows = apply(vectors, model, id_column, vector_column)
    off = 0.0 if model is None else identity_error(vectors, model, id_column, vector_column)
    shares = [] if model is None else (model.values[: model.projection.shape[1]] / model.trace).tolist()
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(0 if model is None else model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*map(F.lit, shares or [0.0])), F.col("place") + 1).alias("explained"),
        F.lit(off).alias("identity_error"),
    )


QUERY = "op13_whitening"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


#: Eigenvectors are not SQL; tests compare with LAPACK and exact integers.
ORACLE_SQL = None
