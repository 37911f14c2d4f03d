"""Nowcast facts: reading, resuming and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["as_of", "target_quarter", "method"]
SCHEMA = "as_of date, target_quarter string, horizon int, method string, nowcast_level double, nowcast_z double, realised double, error double, n_iter double, converged boolean"


def read_facts(spark: SparkSession, path: str, periods: list[str] | None = None) -> DataFrame:
    """All fact CSVs under path with `period` from the file name; rows not scored are dropped. Unknown periods raise."""
    rows = spark.read.option("header", True).schema(SCHEMA).csv(path)
    rows = rows.withColumn("period", F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}_\d{4}-\d{2})", 1))
    if periods is not None:
        known = {r["period"] for r in rows.select("period").distinct().collect()}
        if unknown := set(periods) - known:
            raise ValueError(f"unknown periods: {sorted(unknown)}")
        rows = rows.filter(F.col("period").isin(*periods))
    return rows.filter(F.col("realised").isNotNull() & F.col("nowcast_level").isNotNull())


def newest_file(spark: SparkSession, path: str) -> str:
    """The name of the file under path that was modified last, from the listing alone."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "modificationTime")
    return files.orderBy(F.desc("modificationTime"), F.desc("name")).first()["name"]


def pending(work: DataFrame, done: DataFrame) -> DataFrame:
    """The work list's rows whose key has no result yet."""
    return work.join(done.select(*KEY).distinct(), KEY, "left_anti")


def append_facts(facts: DataFrame, path: str, batch: int) -> None:
    """Appends a batch, whole or not at all; read_stored lets the latest batch of a key win, so writing one twice does no harm."""
    facts.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").partitionBy("method").parquet(path)


def latest(stored: DataFrame) -> DataFrame:
    """One row for each key, that of the greatest batch, of one batch the greatest row, without `batch`; nulls are least."""
    others = [c for c in stored.columns if c not in (*KEY, "batch")]
    won = stored.groupBy(*KEY).agg(F.max(F.struct("batch", *others)).alias("won"))
    return won.select(*KEY, *[F.col(f"won.{c}").alias(c) for c in others])


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The facts under path, each key once."""
    return latest(spark.read.parquet(path))
