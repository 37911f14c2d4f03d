"""A stream gives what the table gives."""

import datetime
import random

from pyspark.sql import functions as F

from tidemark.sources import facts
from tidemark.streaming import upsert, windows


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "user_id", "event_type", "value")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, of in (("daily", windows.daily_means), ("sliding", lambda e: windows.windowed(e, "6 hours", "2 hours"))):
        query = of(stream).writeStream.format("memory").queryName(name).outputMode("complete").start()
        query.processAllAvailable()
        query.stop()
        key = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in of(events).dtypes]
        got, want = spark.table(name).select(*key), of(events).select(*key)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_stream_of_batches_equals_the_table(spark, tmp_path):
    rng = random.Random(0)
    day = datetime.date(2000, 1, 15)
    rows = [(day + datetime.timedelta(days=rng.randrange(40)), rng.choice(["2000Q1", "2000Q2"]), "mean", rng.choice([1, 2, 3, 3]), rng.choice([None, 1.0, 2.0])) for _ in range(300)]
    table = spark.createDataFrame(rows, "as_of date, target_quarter string, method string, batch int, nowcast_level double")
    want = sorted(map(repr, facts.latest(table).collect()))
    for order in range(2):
        folder = tmp_path / f"in{order}"
        parts = table.randomSplit([1.0] * 3, seed=order)
        for part in parts if order else reversed(parts):
            part.coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        for _ in range(2):  # a second run finds nothing new
            upsert.upsert_stream(stream, str(tmp_path / f"out{order}"), str(tmp_path / f"check{order}"))
        stored = spark.read.parquet(str(tmp_path / f"out{order}")).drop("run")
        assert sorted(map(repr, facts.latest(stored).collect())) == want


def test_timers_bound_the_state(spark, tmp_path):
    folder, rows = tmp_path / "in", [("2000-01-15", 2, 5.0), ("2003-01-15", 1, 6.0), ("2000-01-15", 1, 4.0)]
    for k, (as_of, batch, level) in enumerate(rows):
        one = spark.createDataFrame([(datetime.date.fromisoformat(as_of), "q", "mean", batch, level)], "as_of date, target_quarter string, method string, batch int, nowcast_level double")
        one.coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(one.schema).parquet(str(folder))
        upsert.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), keep_days=30)
    stored = spark.read.parquet(str(tmp_path / "out")).drop("run")
    assert {(str(r.as_of), r.nowcast_level) for r in facts.latest(stored).collect()} == {("2000-01-15", 5.0), ("2003-01-15", 6.0)}
