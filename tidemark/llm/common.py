"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import broadcast_limit, discard, materialise, measured, renamed, scope, sized, weight

__all__ = ["ascii_lower", "discard", "lookup", "materialise", "measured", "renamed", "repeated_rows", "scope", "sized", "table", "tasks_for", "weight"]

#: A key is hot if it has more than this share of all rows, so at most 1,000 keys are.
HOT_SHARE = 0.001

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def lookup(big: DataFrame, small: DataFrame, keys: list[str], of: DataFrame | None = None) -> DataFrame:
    """Left join of big with small, which has each key once.

    Within the limit, small is broadcast. Beyond, both are shuffled by the key and
    a salt: a key with more than HOT_SHARE of big's rows (at most 1,000 such keys
    exist) is dealt to several tasks and its row of small is repeated for each.
    """
    if weight(small if of is None else of)[1] <= broadcast_limit():
        return big.join(F.broadcast(small), keys, "left")
    counts = materialise(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "counts")
    share = max(1, int((counts.agg(F.sum("_n")).first()[0] or 0) * HOT_SHARE))
    hot = counts.filter(F.col("_n") > share).select(*keys, F.ceil(F.col("_n") / share).cast("int").alias("_salts"))
    dealt = big.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.coalesce("_salts", F.lit(1))).cast("int"))
    repeated = small.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    return dealt.drop("_salts").join(repeated.drop("_salts"), [*keys, "_salt"], "left").drop("_salt")


def repeated_rows(df: DataFrame, copies: str) -> DataFrame:
    """Each row of df as often as its column `copies` says, without that column."""
    return df.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop(copies)


def tasks_for(df: DataFrame, task_bytes: int) -> int:
    """Tasks of about so many bytes for a materialised table, and no fewer than Spark's shuffles have."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(weight(df)[1] / task_bytes))
