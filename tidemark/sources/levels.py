"""Raw monthly levels and the quarterly target, aggregated from the order tables.

Each table is read once: its months are aggregated with partial sums in the scan's
stage and kept in one partition, a row for each month at any size of the table. All that refers to
them goes on from these rows, in one query or in several of a session; a lost
executor's are aggregated again. A table that is written anew under its path by
another session needs `spark.catalog.refreshByPath`. Money and rates are summed as
decimals, so the sums don't depend on the order in which executors deliver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import month_end, quarter_end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _total(column: str, kind: str = "decimal(18,4)") -> Column:
    return F.sum(F.col(column).cast(kind)).cast("double")


def order_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, total, n, last): each month's order value, orders and last day with one; kept."""
    day = F.col("o_orderdate").cast("date")
    months = table(spark, sf_dir, "orders").groupBy(month_end(day).alias("date"))
    return months.agg(F.sum(F.col("o_totalprice").cast("decimal(18,4)")).alias("total"), F.count(F.lit(1)).alias("n"), F.max(day).alias("last")).repartition(1).persist()


def line_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date and a column for each series of the lines; kept."""
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "lineitem").groupBy(month_end(F.col("l_shipdate").cast("date")).alias("date")).agg(
        _total("l_quantity").alias("shipped_qty"),
        (_total("l_discount") / n).alias("avg_discount"),
        (_total("l_tax") / n).alias("avg_tax"),
        (_total("l_extendedprice") / _total("l_quantity")).alias("unit_price"),
        (_total("l_quantity") / n).alias("avg_quantity"),
    ).repartition(1).persist()


def monthly_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, date, value) at month ends."""
    line = line_months(spark, sf_dir)
    orders = order_months(spark, sf_dir).select("date", F.col("total").cast("double").alias("order_value"), F.col("n").cast("double").alias("order_count"))
    long = lambda df: df.unpivot(["date"], [c for c in df.columns if c != "date"], "series", "value").select("series", "date", "value")
    return long(line).unionByName(long(orders))


def quarterly_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, value): growth of the order value in percent, at the ends of quarters that, like the one before, have three whole months."""
    months = order_months(spark, sf_dir).select(F.col("date").alias("month"), "total", "last")
    whole = months.filter(F.datediff("month", "last") < 7)  # a month that stops early is not whole
    quarters = whole.groupBy(quarter_end(F.col("month")).alias("date")).agg(F.sum("total").cast("double").alias("total"), F.count(F.lit(1)).alias("n"))
    full = quarters.filter("n = 3")
    by_date = Window.orderBy("date")  # a row for each quarter, after aggregation
    before = F.lag("date").over(by_date)
    growth = F.when(before == F.last_day(F.add_months("date", -3)), 100 * (F.log("total") - F.lag(F.log("total")).over(by_date)))
    return full.select("date", growth.alias("value")).filter(F.col("value").isNotNull())
