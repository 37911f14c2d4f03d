"""Stored fits and Monte Carlo scenarios: Parquet rows of arrays, JSON with null for values that aren't finite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that are infinite, not unknown, when a JSON file has null: the degrees of freedom of Gaussian models.
INFINITE = ("nu_u", "nu_eps", "nu_contam")


def scenario_name(estimator: Column, months: Column, pi: Column, replications: Column) -> Column:
    return F.format_string("mc_%s_T%04d_pi%.2f_S%d.json", estimator, months, pi, replications)


def json_safe(df: DataFrame) -> DataFrame:
    """df with numbers that aren't finite as null, in arrays, structs and maps too, however deep."""
    return df.select(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def _finite(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, T.ArrayType) and _has_doubles(kind.elementType):
        return F.transform(value, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.MapType) and _has_doubles(kind.valueType):
        return F.transform_values(value, lambda _, x: _finite(x, kind.valueType))
    if isinstance(kind, T.StructType) and _has_doubles(kind):
        return F.when(value.isNotNull(), F.struct(*[_finite(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return value


def _has_doubles(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_doubles(f.dataType) for f in kind)
    inner = getattr(kind, "elementType", None) or getattr(kind, "valueType", None)
    return isinstance(kind, T.DoubleType | T.FloatType) or inner is not None and _has_doubles(inner)


def write_json(df: DataFrame, path: str) -> None:
    json_safe(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).json(path)
    return rows.select(*[F.coalesce(c, F.lit(float("inf"))).alias(c) if c in INFINITE else F.col(c) for c in rows.columns])


def save_fits(fits: DataFrame, path: str) -> None:
    """Appends fits; a batch is committed whole or not at all."""
    fits.write.mode("append").parquet(path)


def load_fits(spark: SparkSession, path: str, fit_ids: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if fit_ids is None else rows.filter(F.col("fit_id").isin(*fit_ids))


def unfinished(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a grid whose whole key, the fit's settings included, has no result yet."""
    return work.join(done.select(*key).distinct(), key, "left_anti")


def settings_name(settings: list[str]) -> Column:
    """A name for the settings in the given columns: equal settings, equal name, whatever the columns' order."""
    each = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in sorted(settings)]
    return F.substring(F.sha1(F.concat_ws(";", *each)), 1, 12)


def resumed(work: DataFrame, done: DataFrame, key: list[str], settings: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(to do, kept, stale): work without a result under its settings, results to go on with, and results of other settings.

    A result counts if its key is in the work list and its settings are equal to
    that row's; results of the same key under other settings are stale, and their
    work is to do again. Results whose key isn't asked for are neither. Several
    results of one key and settings are all kept.
    """
    asked = work.select(*key, settings_name(settings).alias("_asked")).distinct()
    named = done.withColumn("_had", settings_name(settings))
    met = named.join(asked, key)
    kept = met.filter("_had = _asked").drop("_had", "_asked")
    stale = met.filter("_had <> _asked").drop("_had", "_asked")
    todo = work.join(kept.select(*key).distinct(), key, "left_anti")
    return todo, kept, stale


def drifted(stats: DataFrame, stored: DataFrame, key: list[str], tolerance: float = 1e-10) -> DataFrame:
    """Keys whose mean or std is off the stored one by more than the tolerance, or has none."""
    old = stored.select(*key, F.col("mean").alias("old_mean"), F.col("std").alias("old_std"))
    off = F.greatest(F.abs(F.col("mean") - F.col("old_mean")), F.abs(F.col("std") - F.col("old_std")))
    return stats.join(old, key, "left").withColumn("off", off).filter(F.col("off").isNull() | (F.col("off") > tolerance))
