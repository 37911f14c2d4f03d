"""Tables that queries write on the way, in the folder that the cluster shares.

Writing a table cuts the lineage and lets a lost executor's work be read again.
Tables belong to the scope that is open where they are written, if any, and go when
it closes; without a scope they go when the driver's JVM ends. A scope is the
thread's own, so queries that are built side by side never delete each other's.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import math
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Measured bytes up to which a table may be broadcast, rows counting ROW_BYTES each beside their values.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 24
#: Bytes meant for a task of a result that is bounded by a measured table.
SMALL_TASK_BYTES = 8 << 20

_local: dict[str, str] = {}
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_measured: weakref.WeakKeyDictionary[DataFrame, dict] = weakref.WeakKeyDictionary()
_scope: contextvars.ContextVar[Scope | None] = contextvars.ContextVar("scope", default=None)


class Scope:
    """The tables that were written while it was open; keep() takes one out."""

    def __init__(self):
        self.paths: set[str] = set()
        self.kept: set[str] = set()

    def keep(self, made: DataFrame) -> DataFrame:
        """made, which outlives this scope: it passes to the one around it, if any."""
        path = _written.get(made, "")
        if path in self.paths:
            self.paths.remove(path)
            self.kept.add(path)
        return made


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Deletes, when it closes, the tables that were written within it in this thread, but those that were kept."""
    own = Scope()
    around = _scope.get()
    token = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(token)
        if around is not None:
            around.paths |= own.kept
        for path in own.paths:
            _delete(spark, path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a session on one machine may do without; it gets a temporary folder. The
    cluster's word is taken for it that its executors share what it names: a path
    without a scheme, or file:, can be a mounted store.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if folder:
        return folder
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _local:
        _local[key] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _local[key], ignore_errors=True)
    return _local[key]


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes with the scope, or with the driver's JVM."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    folder, files = file_system(spark, path)
    files.deleteOnExit(folder)
    if (own := _scope.get()) is not None:
        own.paths.add(path)
    return path


def materialise(df: DataFrame, name: str, within: DataFrame | None = None, group_bytes: int | None = None, **measures: Column) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again.

    Rows, bytes and further aggregates are measured while it is written. within: a
    table whose measured bytes bound df's, so that a small result is not cut into
    many tasks and files, however many partitions Spark shuffles to. group_bytes: at
    about so many bytes a row group is closed, for rows that are large when decoded.
    It is an eager job, so whoever uses it runs part of the work while the query is
    built.
    """
    path = new_path(df.sparkSession, name)
    if within is not None:
        df = df.coalesce(max(1, math.ceil(weight(within)[1] / SMALL_TASK_BYTES)))
    seen = Observation()
    columns = [c.alias(k) for k, c in measures.items()]
    writer = df.observe(seen, F.count(F.lit(1)).alias("_rows"), F.sum(_row_bytes(df)).alias("_bytes"), *columns).write.option("compression", "zstd")
    if group_bytes is not None:
        writer = writer.option("parquet.block.size", group_bytes)
    writer.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[made], _measured[made] = path, seen.get
    return made


def renamed(made: DataFrame, **names: str) -> DataFrame:
    """A materialised table with columns renamed, which keeps its measures."""
    other = made.withColumnsRenamed(names)
    _written[other], _measured[other] = _written[made], _measured[made]
    return other


def measured(made: DataFrame, name: str):
    """An aggregate that was taken while a materialised table was written."""
    return _measured[made][name]


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing reads any more; others are left alone."""
    for made in tables:
        if (path := _written.pop(made, None)) is not None:
            if (own := _scope.get()) is not None:
                own.paths.discard(path)
            _delete(made.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder, files = file_system(spark, path)
    files.delete(folder, True)


def file_system(spark: SparkSession, path: str):
    """(path, file system) as Hadoop's objects."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def weight(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes): the values' own bytes and ROW_BYTES for each row, as measured when df was written; others are aggregated now."""
    if df in _measured:
        return measured(df, "_rows") or 0, measured(df, "_bytes") or 0
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first())


def _row_bytes(df: DataFrame) -> Column:
    each = F.lit(ROW_BYTES).cast("long")
    for column in df.schema.fields:
        each = each + F.coalesce(_bytes(F.col(f"`{column.name}`"), column.dataType), F.lit(0))
    return each


def _bytes(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.octet_length(value).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType):
            return F.aggregate(value, F.lit(24).cast("long"), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
        return F.size(value).cast("long") * (8 if not isinstance(kind.elementType, T.StructType) else 8 * len(kind.elementType.fields) + 16) + 24
    return F.lit(16 if isinstance(kind, T.DecimalType | T.StructType) else 8).cast("long")


def broadcast_limit() -> int:
    """BROADCAST_BYTES, read at each call, so that tests and sessions can change it."""
    return BROADCAST_BYTES


def sized(df: DataFrame, of: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """df, to be broadcast if its measured bytes are within the limit; else Spark shuffles.

    of: the materialised table that df selects from, whose bytes bound df's.
    """
    return F.broadcast(df) if weight(df if of is None else of)[1] <= (broadcast_limit() if limit is None else limit) else df
