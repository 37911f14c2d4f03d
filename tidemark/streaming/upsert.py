"""Facts that arrive in batches on a stream: of each key the latest batch's row, kept in the stream's state.

A key is (as_of, target_quarter, method). Its state holds the best row so far: that
of the greatest batch, of one batch the greatest row. A micro-batch emits the keys
whose row has changed, so what is emitted last is what `latest` gives for all rows
at once, whatever the order in which files arrive. An event-time timer drops a
key's state some days after its as_of, so state is bounded by the facts of that span.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.facts import KEY

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rank(row: tuple) -> tuple:
    """A row's order within a key, nulls first; the batch comes first in it."""
    return tuple((v is not None, v if v is not None else 0) for v in row)


class LatestRow(StatefulProcessor):
    """Keeps a key's greatest row (batch, then the values) and emits it when it changes."""

    def __init__(self, values: T.StructType):
        self.values = values

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", self.values)
        self.timed = handle.getValueState("timed", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        old = tuple(self.best.get()) if self.best.exists() else None
        best, seen = old, None
        for row in rows:
            own = tuple(row[f.name] for f in self.values)
            seen = row["_event_time"] if seen is None else max(seen, row["_event_time"])
            if best is None or _rank(own) > _rank(best):
                best = own
        if not self.timed.exists():
            at = max(int(seen.timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + 1
            self.handle.registerTimer(at)
            self.timed.update((at,))
        if best != old:
            self.best.update(best)
            yield Row(**dict(zip([*KEY, *self.values.names], [*key, *best], strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.best.clear()
        self.timed.clear()
        return iter([])

    def close(self) -> None:
        pass


def latest_facts(stream: DataFrame, keep_days: int = 3650) -> DataFrame:
    """The stream (KEY, batch, values) as updates: KEY, batch and values of each key whose latest row a micro-batch has changed.

    Rows that repeat change nothing. A null batch is below all others. The watermark
    follows the greatest as_of by keep_days: a key whose as_of it has passed is
    final, its state goes, and rows that come for it later are dropped. So is a null
    as_of, which has no event time.
    """
    others = [f for f in stream.schema if f.name not in KEY]
    values = T.StructType([f for f in others if f.name == "batch"] + [f for f in others if f.name != "batch"])
    keys = T.StructType([stream.schema[k] for k in KEY])
    timed = stream.filter("as_of IS NOT NULL").withColumn("_event_time", F.col("as_of").cast("timestamp")).withWatermark("_event_time", f"{keep_days} days")
    processor = LatestRow(T.StructType([T.StructField(f.name, f.dataType) for f in values]))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in [*keys, *values]])
    return timed.groupBy(*KEY).transformWithState(processor, schema, "Update", "EventTime")


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keep_days: int = 3650) -> None:
    """Runs the stream over all that has arrived and appends each micro-batch's updates under path, once even if a batch is run again.

    facts.latest of what is stored there has each key once. A restart with the same
    checkpoint goes on where the last run stopped.
    """

    def store(updates: DataFrame, number: int) -> None:
        # a batch that is run again after a failure replaces its own folder
        updates.write.mode("overwrite").parquet(f"{path}/run={number}")

    with rocks_state(stream.sparkSession):
        query = latest_facts(stream, keep_days).writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


@contextlib.contextmanager
def rocks_state(spark: SparkSession):
    """The state store that keyed state needs, for the queries that are started within."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
