"""Training-data operators: thirteen numbered components and their queries.

Nothing else in the library imports this subpackage.
"""

from __future__ import annotations

from importlib import import_module

#: One module for each numbered operator; each has QUERY, query() and ORACLE_SQL.
MODULES = (
    "url_filter",
    "exact_dedup",
    "decontaminate",
    "sharding",
    "chat_format",
    "simhash",
    "secrets_scan",
    "language_id",
    "packing",
    "suffix_dedup",
    "byte_bpe",
    "resampling",
    "whitening",
)


def _modules():
    return [import_module(f"{__name__}.{name}") for name in MODULES]


def queries() -> dict:
    """name -> callable(spark, sf_dir), in the order of the operators."""
    return {m.QUERY: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    """name -> DuckDB SQL, for the operators that SQL can express."""
    return {m.QUERY: m.ORACLE_SQL for m in _modules() if m.ORACLE_SQL}
