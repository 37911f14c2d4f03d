"""Special functions that Spark lacks, for numpy arrays and as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the recurrence before the asymptotic series is used.
_STEPS = 8


def _series(i):
    return i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def digamma(x):
    """The logarithmic derivative of the gamma function for x > 0: recurrence up to 6, then the asymptotic series."""
    x = np.array(x, dtype=float, ndmin=1)
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    return out + np.log(x) - 0.5 / x - _series(1 / (x * x))


def digamma_column(x: Column) -> Column:
    """digamma of a column of positive doubles, by the same recurrence and series."""
    y = x + _STEPS
    made = F.log(y) - 0.5 / y - _series(1 / (y * y))
    for k in range(_STEPS):
        made = made - 1 / (x + k)
    return made


def digamma_sql(x: str) -> str:
    """digamma_column of an SQL expression, as SQL text."""
    y = f"({x} + {float(_STEPS)!r}::DOUBLE)"
    i = f"(1 / ({y} * {y}))"
    series = f"{i} * (1 / 12.0::DOUBLE - {i} * (1 / 120.0::DOUBLE - {i} * (1 / 252.0::DOUBLE - {i} * (1 / 240.0::DOUBLE - {i} / 132.0::DOUBLE))))"
    return f"(ln({y}) - 0.5::DOUBLE / {y} - {series}" + "".join(f" - 1 / ({x} + {k})" for k in range(_STEPS)) + ")"
