"""Without any broadcast every operator gives the same rows."""

import pytest

from tidemark import llm, storage

SF = "/root/testdata/sf0.001"
#: Queries that look up or join measured tables; packing deals by task counts alone.
NAMES = ["op1_url_filter", "op2_exact_dedup", "op3_decontaminate", "op4_sharding", "op6_simhash", "op7_secrets_scan", "op10_suffix_dedup", "op12_resampling"]


@pytest.mark.parametrize("name", NAMES)
def test_equal_results_beyond_the_broadcast_limit(spark, monkeypatch, name):
    query = llm.queries()[name]
    want = sorted(map(repr, query(spark, SF).collect()))
    monkeypatch.setattr(storage, "BROADCAST_BYTES", -1)
    made = query(spark, SF)
    assert sorted(map(repr, made.collect())) == want and want


def test_lookup_salts_hot_keys_beyond_the_limit(spark, monkeypatch):
    from tidemark.llm.common import lookup

    monkeypatch.setattr(storage, "BROADCAST_BYTES", -1)
    big = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 7, id) AS k")
    small = spark.range(0, 4000, 2).selectExpr("id AS k", "id * 10 AS v").unionByName(spark.createDataFrame([(7, 70)], "k long, v long"))
    got = {r.id: r.v for r in lookup(big, small, ["k"]).collect()}
    want = {i: (lambda k: 70 if k == 7 else k * 10 if k % 2 == 0 and k < 4000 else None)(7 if i % 3 == 0 else i) for i in range(5000)}
    assert got == want


def test_components_of_a_hub_beyond_the_limit(spark, monkeypatch):
    from tidemark.llm.components import components

    monkeypatch.setattr(storage, "BROADCAST_BYTES", -1)
    links = spark.range(1, 3000).selectExpr("0L AS a", "id AS b").unionByName(spark.createDataFrame([(5000, 5001), (5001, 5002)], "a long, b long"))
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(3000)} | {5000: 5000, 5001: 5000, 5002: 5000}
