"""The series registry: a JSON list of series, read as a small table and validated."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS, FREQUENCIES, SOURCES = ("real", "financial", "other"), ("monthly", "quarterly"), ("table", "current", "spread")
SCHEMA = "series array<struct<name:string,block:string,freq:string,source:string,transform:int,components:array<string>,lag:int>>"
DEFAULT = Path(__file__).with_name("series.json")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, block, freq, source, transform, components, lag); the list's order is the canonical one."""
    rows = spark.read.schema(SCHEMA).json(path, multiLine=True)
    return rows.select(F.posexplode("series").alias("ord", "s")).select("ord", "s.*")


def default_registry(spark: SparkSession) -> DataFrame:
    """The registry that comes with the package, which is small text, as a table."""
    # literals over a range rather than local rows: plans of two calls compare as equal
    rows = spark.range(0, 1, 1, 1).select(F.lit(DEFAULT.read_text()).alias("text"))
    return rows.select(F.posexplode(F.from_json("text", SCHEMA)["series"]).alias("ord", "s")).select("ord", "s.*")


def registry_errors(registry: DataFrame) -> DataFrame:
    """(name, error) for each rule that a series breaks; a valid registry has none."""
    table_code = F.col("source").isin("table", "spread") & F.col("transform").isNull()
    rules = [
        ("no name", F.col("name").isNull()),
        ("unknown block", ~F.coalesce(F.col("block").isin(*BLOCKS), F.lit(False))),
        ("unknown frequency", ~F.coalesce(F.col("freq").isin(*FREQUENCIES), F.lit(False))),
        ("unknown source", ~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False))),
        ("no transform", F.coalesce(table_code, F.lit(False))),
        ("transform out of range", F.coalesce(~F.col("transform").between(1, 7), F.lit(False))),
        ("a spread needs two components", (F.col("source") == "spread") & (F.coalesce(F.size("components"), F.lit(0)) != 2)),
    ]
    broken = F.filter(F.array(*[F.when(test, F.lit(text)) for text, test in rules]), lambda e: e.isNotNull())
    own = registry.select("name", F.explode(broken).alias("error"))
    twice = registry.groupBy("name").count().filter("count > 1").select("name", F.lit("duplicate name").alias("error"))
    return own.unionByName(twice)
