"""The registry of the library's queries and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import events, models, moment_queries, panels, records, scores
from .base import rounded

_PARTS = (panels, scores, moment_queries, records, events, models)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random-walk nowcasts over the rolling calendar, scored by horizon."""
    return rounded(scores.accuracy_by_method_horizon(spark, sf_dir))


def queries() -> dict:
    def of(query):
        return lambda spark, sf_dir: rounded(query(spark, sf_dir))

    return {name: of(q) for part in _PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for part in _PARTS for name, text in part.SQL.items()}
