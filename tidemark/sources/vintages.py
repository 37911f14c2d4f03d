"""Vintage files: one CSV for each month of publication, each with columns of its own.

A file's first row after the header holds transform codes; then come a date and one
number for each series. The month of publication is in the file's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import last_complete_month
from ..functions.transforms import stationary
from ..storage import file_system, new_path

#: File names: YYYY-MM.csv, PREFIX-MD_YYYYmMM.csv, YYYY-MM-MD.csv; earlier vintages than this aren't usable.
NAME_PATTERNS = (r"(?i)^(\d{4})-(\d{1,2})\.csv$", r"(?i)^[A-Z]+-MD_(\d{4})m(\d{1,2})\.csv$", r"(?i)^(\d{4})-(\d{1,2})-MD\.csv$")
FIRST_USABLE = 200008


def vintage_month(file_name: Column) -> Column:
    """YYYYMM from a file's name; null if no pattern fits or the month doesn't exist."""
    found = F.lit(None).cast("int")
    for pattern in reversed(NAME_PATTERNS):
        ym = F.regexp_extract(file_name, pattern, 1).try_cast("int") * 100 + F.regexp_extract(file_name, pattern, 2).try_cast("int")
        found = F.when(file_name.rlike(pattern), ym).otherwise(found)
    return F.when((found % 100).between(1, 12), found)


def list_vintages(spark: SparkSession, folders: str | list[str]) -> DataFrame:
    """(vintage_ym, folder, place, name, path) of the vintage files under the folders, from the listing alone; place is a folder's in the list."""
    folders = [folders] if isinstance(folders, str) else list(folders)
    listed = None
    for place, folder in enumerate(folders):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
        own = files.select(F.lit(folder).alias("folder"), F.lit(place).alias("place"), F.element_at(F.split("path", "/"), -1).alias("name"), "path")
        listed = own if listed is None else listed.unionByName(own)
    return listed.select(vintage_month(F.col("name")).alias("vintage_ym"), "folder", "place", "name", "path").filter("vintage_ym IS NOT NULL")


def read_vintages(spark: SparkSession, folders: str | list[str], first: int | None = None, last: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(values, codes) of the vintages under the folders: (vintage_ym, series, date, value) and (vintage_ym, series, code).

    Each file is read by its own header, so files may differ in the order, number
    and names of their columns. Of one month's files that of the last folder counts;
    first and last (YYYYMM) bound the months, and other files are not opened. A file
    is one row until its lines are taken apart, so it must fit a task, files don't
    meet. Of columns of one name the first counts, columns without a name don't.
    Cells beyond a short line's end are null, so are numbers that can't be read;
    rows without a date that can be read are dropped. The file's first line after
    the header that begins with `transform` has the codes. No file at all raises
    FileNotFoundError.
    """
    files = vintage_index(list_vintages(spark, folders))
    if first is not None:
        files = files.filter(F.col("vintage_ym") >= first)
    if last is not None:
        files = files.filter(F.col("vintage_ym") <= last)
    paths = [r["path"] for r in files.select("path").collect()]  # the listing, which Spark's driver holds anyway
    if not paths:
        raise FileNotFoundError(f"no vintage files under {folders}")
    whole = spark.read.text(paths, wholetext=True)
    lines = F.filter(F.split(F.regexp_replace("value", "^\ufeff", ""), r"\r?\n"), lambda x: F.trim(x) != "")
    named = whole.select(vintage_month(F.col("_metadata.file_name")).alias("vintage_ym"), lines.alias("lines"))
    header = F.transform(_cells(F.col("lines")[0]), F.trim)
    rows = named.select("vintage_ym", header.alias("header"), F.explode(F.slice("lines", F.lit(2), F.size("lines"))).alias("line"))
    rows = rows.select("vintage_ym", "header", _cells(F.col("line")).alias("cells")).withColumn("day", F.trim(F.col("cells")[0]))
    at = F.transform("header", lambda name, i: F.struct(name.alias("series"), F.get("cells", i).try_cast("double").alias("value"), ((i > 0) & (name != "") & (F.array_position("header", name) == i + 1)).alias("counts")))
    long = rows.select("vintage_ym", "day", F.explode(F.filter(at, lambda x: x["counts"])).alias("x")).select("vintage_ym", "day", "x.series", "x.value")
    is_code = F.lower("day").startswith("transform")
    codes = long.filter(is_code).select("vintage_ym", "series", F.col("value").cast("int").alias("code"))
    day = F.coalesce(F.expr("CAST(try_to_timestamp(day, 'M/d/yyyy') AS DATE)"), F.expr("TRY_CAST(day AS DATE)"))
    values = long.filter(~is_code).select("vintage_ym", "series", day.alias("date"), "value").filter(F.col("date").isNotNull())
    return values, codes


def _cells(line: Column) -> Column:
    """A CSV line's cells; commas within quotes belong to the cell."""
    return F.transform(F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda x: F.regexp_replace(x, '^\\s*"|"\\s*$', ""))


def write_vintages(values: DataFrame, codes: DataFrame, folder: str, order: DataFrame | None = None) -> None:
    """Writes each vintage of values as folder/YYYY-MM.csv with the columns that it has, in the layout that read_vintages reads.

    order (vintage_ym, series, place): the place of a vintage's column; names
    decide among equal ones, and without it. Columns without a code have an empty
    one. Files are written by Spark, one task a vintage, and take their names when
    all are written; a file of that name is replaced.
    """
    spark, places = values.sparkSession, order
    if places is None:
        places = values.select("vintage_ym", "series").distinct().withColumn("place", F.lit(0))
    columns = values.select("vintage_ym", "series").distinct().join(places, ["vintage_ym", "series"], "left").join(codes, ["vintage_ym", "series"], "left")
    heads = columns.groupBy("vintage_ym").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("place", F.lit(0)).alias("place"), "series", "code"))).alias("columns"))
    cell = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    days = values.groupBy("vintage_ym", "date").agg(F.map_from_entries(F.collect_list(F.struct("series", "value"))).alias("row"))
    days = days.join(heads, "vintage_ym")
    line = F.concat_ws(",", F.date_format("date", "M/d/yyyy"), F.array_join(F.transform("columns", lambda c: cell(F.element_at("row", c["series"]))), ","))
    files = days.groupBy("vintage_ym", "columns").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    first = F.concat_ws(",", F.lit("date"), F.array_join(F.transform("columns", lambda c: c["series"]), ","))
    second = F.concat_ws(",", F.lit("Transform:"), F.array_join(F.transform("columns", lambda c: cell(c["code"])), ","))
    name = F.format_string("%04d-%02d.csv", F.floor(F.col("vintage_ym") / 100), F.col("vintage_ym") % 100)
    made = files.select(F.concat_ws("\n", first, second, "body").alias("value"), name.alias("file"))
    staged = new_path(spark, "vintages")
    made.write.partitionBy("file").text(staged)
    root, system = file_system(spark, staged)
    target, _ = file_system(spark, folder)
    system.mkdirs(target)
    path = lambda parent, child: spark._jvm.org.apache.hadoop.fs.Path(parent, child)
    for each in system.listStatus(root):  # a file for each vintage, so few
        if not each.isDirectory():
            continue
        part = next(f.getPath() for f in system.listStatus(each.getPath()) if f.getPath().getName().startswith("part-"))
        final = path(target, each.getPath().getName().removeprefix("file="))
        system.delete(final, False)
        system.rename(part, final)
    system.delete(root, True)


def available_vintages(values: DataFrame, include_unusable: bool = False) -> DataFrame:
    months = values.select("vintage_ym").distinct()
    return months if include_unusable else months.filter(F.col("vintage_ym") >= FIRST_USABLE)


def resolve_vintage(values: DataFrame, vintage_ym: int) -> DataFrame:
    """The rows of one vintage. Before the first usable month, or without rows, it raises ValueError or FileNotFoundError."""
    if vintage_ym < FIRST_USABLE:
        raise ValueError(f"vintage {vintage_ym} is before {FIRST_USABLE}")
    found = values.filter(F.col("vintage_ym") == vintage_ym)
    if found.isEmpty():
        raise FileNotFoundError(f"no vintage {vintage_ym}")
    return found


def with_canonical_names(values: DataFrame, aliases: DataFrame) -> DataFrame:
    """values with `series` renamed by aliases (series, source, after_ym, until_ym): after_ym < vintage_ym <= until_ym.

    An inner range rule on a small table, met by an equi-join on the source name.
    """
    a = aliases.select(F.col("series").alias("_to"), F.col("source").alias("series"), "after_ym", "until_ym")
    within = (F.col("vintage_ym") > F.col("after_ym")) & (F.col("vintage_ym") <= F.col("until_ym"))
    joined = values.join(a, "series", "left").withColumn("_in", F.coalesce(within, F.lit(False)))
    # a name that an alias knows counts in its months alone; other names are canonical
    kept = joined.filter(F.col("_to").isNull() | F.col("_in"))
    return kept.withColumn("series", F.coalesce("_to", "series")).drop("_to", "_in", "after_ym", "until_ym")


def vintage_index(files: DataFrame) -> DataFrame:
    """(vintage_ym, folder, name, ...) from (folder, place, name, ...): of one month's files that of the folder with the greatest place."""
    months = files.withColumn("vintage_ym", vintage_month(F.col("name"))).filter(F.col("vintage_ym").isNotNull())
    more = [c for c in files.columns if c not in ("vintage_ym", "folder", "place", "name")]
    best = months.groupBy("vintage_ym").agg(F.max(F.struct("place", "folder", "name", *more)).alias("f"))
    return best.select("vintage_ym", "f.folder", "f.name", *[f"f.{c}" for c in more])


def load_vintages(
    values: DataFrame, codes: DataFrame, aliases: DataFrame, registry: DataFrame, late: DataFrame | None = None, allow_missing: bool = False, known_late: DataFrame | None = None, start: str | None = None
) -> DataFrame:
    """(vintage_ym, series, date, value): each vintage's dense panel under the codes of its own file.

    Names are made canonical first. A file without a code for a series uses the
    registry's. A registry series that a vintage lacks raises, unless allowed, or
    known to be lacking: those of known_late (series, first_ym) before that vintage,
    and those that aliases name. It is null then. late (series, months): series
    that are known to come late lose so many months at a vintage's end. Dates
    before start are left out, once they have been differenced.
    """
    own = with_canonical_names(values, aliases).withColumn("date", F.last_day("date"))
    wanted = registry.filter("source = 'table'").select(F.col("name").alias("series"), "transform")
    span = own.groupBy("vintage_ym").agg(F.trunc(F.min("date"), "month").alias("first"), F.max("date").alias("last"))
    grid = span.join(F.broadcast(wanted))
    if not allow_missing:
        absent = grid.join(own.select("vintage_ym", "series").distinct(), ["vintage_ym", "series"], "left_anti").join(aliases.select("series").distinct(), "series", "left_anti")
        if known_late is not None:
            absent = absent.join(known_late, "series", "left").filter(F.col("first_ym").isNull() | (F.col("vintage_ym") >= F.col("first_ym")))
        absent = absent.first()
        if absent:
            raise ValueError(f"vintage {absent['vintage_ym']} lacks {absent['series']}")
    coded = grid.join(with_canonical_names(codes, aliases).select("vintage_ym", "series", "code"), ["vintage_ym", "series"], "left")
    days = coded.select("*", F.explode(F.expr("sequence(first, last, interval 1 month)")).alias("day")).withColumn("date", F.last_day("day"))
    dense = days.join(own.select("vintage_ym", "series", "date", "value"), ["vintage_ym", "series", "date"], "left")
    window = Window.partitionBy("vintage_ym", "series").orderBy("date")
    made = dense.withColumn("value", stationary(F.col("value"), F.coalesce("code", "transform"), window))
    if late is not None:
        cut = made.join(late, "series", "left").withColumn("until", F.last_day(F.add_months("last", -F.coalesce("months", F.lit(0)))))
        made = cut.withColumn("value", F.when(F.col("date") <= F.col("until"), F.col("value")))
    if start is not None:
        made = made.filter(F.col("date") >= F.lit(start).cast("date"))
    return made.select("vintage_ym", "series", "date", "value")


def raw_levels(values: DataFrame, aliases: DataFrame, names: list[str]) -> DataFrame:
    """(vintage_ym, series, date, value) of the named series as published, untransformed, at month ends; a series that a vintage lacks is null at its dates."""
    own = with_canonical_names(values, aliases).withColumn("date", F.last_day("date"))
    each = own.select("vintage_ym", "date").distinct().withColumn("series", F.explode(F.array(*map(F.lit, names))))
    return each.join(own, ["vintage_ym", "series", "date"], "left").select("vintage_ym", "series", "date", "value")


def current_series(panel: DataFrame, names: list[str], as_of: str | None = None, lags: DataFrame | None = None) -> DataFrame:
    """(series, date, value) of revised series, nulls dropped.

    With as_of, months that were not out by then are left out: the last one is the
    last complete month less the series' lag in months (series, lag), 0 if it has
    none. A series that is unknown, or starts later, has no rows.
    """
    rows = panel.filter(F.col("series").isin(*names) & F.col("value").isNotNull()).select("series", "date", "value")
    if as_of is None:
        return rows
    own = rows.withColumn("lag", F.lit(0)) if lags is None else rows.join(lags.select("series", "lag"), "series", "left")
    until = F.last_day(F.add_months(last_complete_month(F.lit(as_of).cast("date")), -F.coalesce("lag", F.lit(0))))
    return own.filter(F.col("date") <= until).select("series", "date", "value")
