import __spark_entry__ as entry


def test_flagship(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0 and "rmse" in frame.columns


def test_sql_is_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
