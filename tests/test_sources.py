import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, transforms
from tidemark.sources import facts, registry, vintages


def test_registry_is_valid(spark):
    reg = registry.default_registry(spark)
    assert registry.registry_errors(reg).count() == 0
    again = registry.read_registry(spark, f"file://{registry.DEFAULT}")
    assert again.orderBy("ord").collect() == reg.orderBy("ord").collect()


def test_vintage_files(spark, tmp_path):
    (tmp_path / "2001-07.csv").write_text("sasdate,A,B\nTransform:,5,2\n1/1/2001,1.5,2\n2/1/2001,x,3\n,,\n")
    (tmp_path / "XX-MD_2001m08.csv").write_text("sasdate,A,B\nTransform:,5,2\n1/1/2001,1.5,2\n2/1/2001,2.5,3\n")
    (tmp_path / "2000-07.csv").write_text("sasdate,A,B\nTransform:,5,2\n1/1/2000,1,2\n")
    values, codes = vintages.read_vintages(spark, str(tmp_path))
    assert codes.filter("vintage_ym = 200107").orderBy("series").select("code").collect() == [(5,), (2,)]
    assert values.filter("vintage_ym = 200107 AND series = 'A'").orderBy("date").select("date", "value").collect() == [(datetime.date(2001, 1, 1), 1.5), (datetime.date(2001, 2, 1), None)]
    assert {r[0] for r in vintages.available_vintages(values).collect()} == {200107, 200108}
    assert {r[0] for r in vintages.available_vintages(values, True).collect()} == {200007, 200107, 200108}
    with pytest.raises(ValueError):
        vintages.resolve_vintage(values, 200007)
    with pytest.raises(FileNotFoundError):
        vintages.resolve_vintage(values, 200201)



def test_vintage_files_of_mixed_layouts(spark, tmp_path):
    old, new = tmp_path / "old", tmp_path / "new"
    old.mkdir(), new.mkdir()
    (old / "2005-01.csv").write_text("sasdate,AAA,BBB\nTransform:,5,2\n1/1/2004,1,10\n2/1/2004,2,20\n")
    (old / "2005-02.csv").write_text("\ufeffsasdate,BBB,CCC,AAA\r\nTransform:,2,4,6\r\n01/01/2004,11,100,1.5\r\n2/1/2004,21,200\r\n,,,\r\n")
    (old / "2005-03.csv").write_text("date,ZZZ\n1/1/2004,9\n")
    (new / "XX-MD_2005m03.csv").write_text('"date","CCC",,"AAA","CCC"\n"Transform:",1,7,3,2\n"1/1/2004","7",5,x,8\n2004-02-01,1e3,,2.5,8\n')
    (new / "notes.txt").write_text("not a vintage")
    values, codes = vintages.read_vintages(spark, [str(old), str(new)])
    day = lambda m: datetime.date(2004, m, 1)
    got = {(r.vintage_ym, r.series, r.date): r.value for r in values.collect()}
    assert got == {
        (200501, "AAA", day(1)): 1.0, (200501, "BBB", day(1)): 10.0, (200501, "AAA", day(2)): 2.0, (200501, "BBB", day(2)): 20.0,
        (200502, "AAA", day(1)): 1.5, (200502, "BBB", day(1)): 11.0, (200502, "CCC", day(1)): 100.0, (200502, "AAA", day(2)): None, (200502, "BBB", day(2)): 21.0, (200502, "CCC", day(2)): 200.0,
        (200503, "AAA", day(1)): None, (200503, "CCC", day(1)): 7.0, (200503, "AAA", day(2)): 2.5, (200503, "CCC", day(2)): 1000.0,
    }
    assert {(r.vintage_ym, r.series): r.code for r in codes.collect()} == {(200501, "AAA"): 5, (200501, "BBB"): 2, (200502, "BBB"): 2, (200502, "CCC"): 4, (200502, "AAA"): 6, (200503, "CCC"): 1, (200503, "AAA"): 3}
    only, _ = vintages.read_vintages(spark, [str(old), str(new)], 200502, 200502)
    assert {r.vintage_ym for r in only.collect()} == {200502} and len(only.inputFiles()) == 1
    with pytest.raises(FileNotFoundError):
        vintages.read_vintages(spark, str(old), 201001)


def test_vintages_are_written_with_their_own_columns(spark, tmp_path):
    rows = [(200501, "a", "2004-01-31", 1.25), (200501, "b", "2004-01-31", None), (200501, "a", "2004-02-29", 2.0), (200502, "c", "2004-01-31", -3e-7), (200502, "a", "2004-01-31", 1.5)]
    values = spark.createDataFrame(rows, "vintage_ym int, series string, date string, value double").withColumn("date", F.col("date").cast("date"))
    codes = spark.createDataFrame([(200501, "a", 5), (200502, "c", 2)], "vintage_ym int, series string, code int")
    order = spark.createDataFrame([(200502, "c", 0), (200502, "a", 1)], "vintage_ym int, series string, place int")
    for _ in range(2):  # writing again replaces
        vintages.write_vintages(values, codes, str(tmp_path / "v"), order)
    assert (tmp_path / "v" / "2005-02.csv").read_text().splitlines()[:2] == ["date,c,a", "Transform:,2,"]
    back, own = vintages.read_vintages(spark, str(tmp_path / "v"))
    key = lambda r: (r.vintage_ym, r.series, str(r.date))
    assert {key(r): r.value for r in back.collect() if r.value is not None} == {tuple(r[:3]): r[3] for r in rows if r[3] is not None}
    assert {(r.vintage_ym, r.series): r.code for r in own.collect() if r.code} == {(200501, "a"): 5, (200502, "c"): 2}


def test_series_known_to_be_late_and_raw_levels(spark):
    reg = spark.createDataFrame([("a", "table", 2), ("b", "table", 1), ("c", "table", 1)], "name string, source string, transform int")
    values = spark.createDataFrame([(200501, "a", "2004-11-01", 1.0), (200501, "a", "2004-12-01", 4.0), (200502, "a", "2004-12-01", 4.5), (200502, "b", "2004-12-01", 7.0)], "vintage_ym int, series string, date string, value double").withColumn("date", F.col("date").cast("date"))
    codes = spark.createDataFrame([], "vintage_ym int, series string, code int")
    aliases = spark.createDataFrame([("c", "c_old", 0, 200412)], "series string, source string, after_ym int, until_ym int")
    late = spark.createDataFrame([("b", 200502)], "series string, first_ym int")
    with pytest.raises(ValueError, match="200501 lacks b"):
        vintages.load_vintages(values, codes, aliases, reg)
    made = vintages.load_vintages(values, codes, aliases, reg, known_late=late, start="2004-12-01")
    assert {(r.vintage_ym, r.series): r.value for r in made.collect()} == {(200501, "a"): 3.0, (200501, "b"): None, (200501, "c"): None, (200502, "a"): None, (200502, "b"): 7.0, (200502, "c"): None}
    raw = vintages.raw_levels(values, aliases, ["b", "a"])
    assert {(r.vintage_ym, r.series, str(r.date)): r.value for r in raw.collect()} == {
        (200501, "a", "2004-11-30"): 1.0, (200501, "b", "2004-11-30"): None, (200501, "a", "2004-12-31"): 4.0, (200501, "b", "2004-12-31"): None, (200502, "a", "2004-12-31"): 4.5, (200502, "b", "2004-12-31"): 7.0,
    }
    panel = values.select("series", F.last_day("date").alias("date"), "value")
    assert vintages.current_series(panel, ["a"], "2005-01-15").count() == 3
    lags = spark.createDataFrame([("a", 1)], "series string, lag int")
    assert [r.value for r in vintages.current_series(panel, ["a", "zz"], "2005-01-15", lags).collect()] == [1.0]


def test_publication_timing(spark):
    rows = spark.createDataFrame([("2008-04-15",), ("2008-05-15",), ("2009-01-15",)], "d string").select(F.col("d").cast("date").alias("as_of"))
    quarters = spark.createDataFrame([("2007-12-31",), ("2008-03-31",), ("2008-06-30",), ("2008-09-30",), ("2008-12-31",)], "d string").select(F.col("d").cast("date").alias("date"), F.lit(1.0).alias("value"))
    from tidemark.operators.rolling import in_flight, published

    out = published(quarters, rows)
    assert [str(r.last_quarter) for r in out.orderBy("as_of").collect()] == ["2007-12-31", "2008-03-31", "2008-09-30"]
    assert in_flight(out).groupBy("as_of").count().orderBy("as_of").collect()[0][1] == 2
    assert rows.select(dates.last_complete_month(F.col("as_of"))).collect()[2][0] == datetime.date(2008, 12, 31)


def test_fill_skips_unobserved_quarters(spark):
    q = spark.createDataFrame([("s", "2000-03-31", 3.0), ("s", "2000-06-30", 6.0), ("s", "2000-09-30", None), ("s", "2000-12-31", 9.0)], "series string, date string, value double")
    assert [r.monthly for r in transforms.quarter_fill(q, ["series"]).orderBy("date").collect()] == [1.0, 2.5, None, 3.25]


def test_unknown_code_and_bad_label_raise(spark):
    from pyspark.sql import Window

    one = spark.createDataFrame([("s", 1, 2.0)], "series string, t int, value double")
    with pytest.raises(Exception, match="unknown transform code"):
        one.select(transforms.stationary(F.col("value"), F.lit(9), Window.partitionBy("series").orderBy("t"))).collect()
    with pytest.raises(Exception, match="not a quarter label"):
        spark.range(1).select(dates.parse_quarter(F.lit("2008Q5"))).collect()


def test_facts_append_read_and_resume(spark, tmp_path):
    csv = tmp_path / "rolling_2008-01_2008-12.csv"
    csv.write_text("as_of,target_quarter,horizon,method,nowcast_level,nowcast_z,realised,error,n_iter,converged\n2008-04-15,2008Q1,4,mean,1.0,0.1,2.0,-1.0,,true\n2008-05-15,2008Q2,2,mean,1.0,0.1,,,,true\n")
    rows = facts.read_facts(spark, str(csv))
    assert rows.count() == 1 and rows.first()["period"] == "2008-01_2008-12"
    with pytest.raises(ValueError):
        facts.read_facts(spark, str(csv), ["1999-01_1999-12"])
    work = spark.createDataFrame([("2008-04-15", "2008Q1", "mean"), ("2008-04-15", "2008Q1", "random_walk")], "as_of string, target_quarter string, method string").withColumn("as_of", F.col("as_of").cast("date"))
    assert [r.method for r in facts.pending(work, rows).collect()] == ["random_walk"]
    for batch, level in ((1, 1.0), (2, 3.0), (2, 3.0)):
        facts.append_facts(rows.withColumn("nowcast_level", F.lit(level)), str(tmp_path / "out"), batch)
    stored = facts.read_stored(spark, str(tmp_path / "out")).collect()
    assert [r.nowcast_level for r in stored] == [3.0]
    assert facts.newest_file(spark, str(csv)) == csv.name


def test_vintage_lacks_a_series(spark):
    reg = registry.default_registry(spark)
    values = spark.createDataFrame([(200101, "order_count", "2000-12-31", 5.0)], "vintage_ym int, series string, date string, value double").withColumn("date", F.col("date").cast("date"))
    codes = spark.createDataFrame([], "vintage_ym int, series string, code int")
    aliases = spark.createDataFrame([], "series string, source string, after_ym int, until_ym int")
    with pytest.raises(ValueError, match="lacks"):
        vintages.load_vintages(values, codes, aliases, reg)
    assert vintages.load_vintages(values, codes, aliases, reg, allow_missing=True).filter("value IS NOT NULL").count() == 0


def test_results_round_trip(spark, tmp_path):
    from tidemark.sources import results

    rows = spark.createDataFrame([("a", 5.0, 1.0), ("b", float("inf"), float("nan"))], "estimator string, nu_u double, value double")
    results.write_json(rows, str(tmp_path / "j"))
    back = {r.estimator: (r.nu_u, r.value) for r in results.read_json(spark, str(tmp_path / "j"), "estimator string, nu_u double, value double").collect()}
    assert back == {"a": (5.0, 1.0), "b": (float("inf"), None)}
    fits = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [3.0])], "fit_id string, loading array<double>")
    results.save_fits(fits, str(tmp_path / "f"))
    assert results.load_fits(spark, str(tmp_path / "f"), ["y"]).first()["loading"] == [3.0]
    assert results.unfinished(fits, fits.filter("fit_id = 'x'"), ["fit_id"]).count() == 1
    stats = spark.createDataFrame([("s", 1.0, 2.0), ("t", 1.0, 2.0)], "series string, mean double, std double")
    assert [r.series for r in results.drifted(stats, stats.filter("series = 's'"), ["series"]).collect()] == ["t"]


def test_resume_tells_stale_settings(spark):
    from tidemark.sources import results

    work = spark.createDataFrame([("a", 1, 100), ("b", 1, 100), ("c", 1, 100)], "name string, seed int, max_iter int")
    done = spark.createDataFrame([("a", 1, 100, 0.5), ("b", 1, 50, 0.6), ("b", 1, None, 0.7), ("z", 1, 100, 0.8)], "name string, seed int, max_iter int, score double")
    todo, kept, stale = results.resumed(work, done, ["name", "seed"], ["max_iter"])
    assert sorted(r.name for r in todo.collect()) == ["b", "c"]
    assert [tuple(r) for r in kept.select("name", "score").collect()] == [("a", 0.5)] and sorted(r.score for r in stale.collect()) == [0.6, 0.7]


def test_json_has_no_numbers_that_are_not_finite(spark, tmp_path):
    from tidemark.sources import results

    nan, inf = float("nan"), float("inf")
    kind = "a array<double>, s struct<x:double,t:array<struct<y:double,n:string>>>, m map<string,double>, f float, n int"
    rows = spark.createDataFrame([([1.0, nan, None, inf], (nan, [(-inf, "k"), (2.0, None)]), {"p": inf, "q": 1.0}, nan, 3), (None, None, None, None, None)], kind)
    made = results.json_safe(rows)
    assert made.schema.simpleString() == rows.schema.simpleString()
    first, second = made.collect()
    assert first.a == [1.0, None, None, None] and first.s.x is None and [t.y for t in first.s.t] == [None, 2.0] and first.m == {"p": None, "q": 1.0} and first.f is None
    assert tuple(second) == (None,) * 5
    results.write_json(rows, str(tmp_path / "x"))
    assert "NaN" not in "".join(p.read_text() for p in (tmp_path / "x").glob("*.json"))
