"""Mined URL rules where single tokens are many or weak."""

import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import url_filter


def judged(spark, rows):
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    return {r.page_id: r.verdict for r in url_filter.judge_urls(pages, labels, rules=()).collect()}


def test_every_supported_host_is_mined(spark):
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}{chr(97 + i // 2 % 20)}{chr(97 + i // 40 % 3)}.example/x/{i}", i % 2) for i in range(1200)]
    assert judged(spark, rows) == {i: "block" if t else "allow" for i, _, t in rows}


def test_tokens_that_are_weak_alone_block_together(spark):
    rows = []
    for i in range(1200):
        a, b = i % 10 in (0, 1, 2), i % 10 in (0, 3, 4)
        strong = i % 10 >= 6
        path = ("/a" if a else "") + ("/b" if b else "") + ("/strong" if strong else "")
        rows.append((i, f"http://h.example{path}/{i}", int(strong or (a and b))))
    assert judged(spark, rows) == {i: "block" if t else "allow" for i, _, t in rows}


def test_support_counts_all_labelled_pages(spark):
    rows = [([], False)] * 900 + [(["p"], True)] * 3 + [(["q"], True)] * 5 + [(["r"], False)] * 92
    labelled = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    got = {tuple(r.tokens): (r.confidence, r.support) for r in url_filter.mine_rules(labelled, min_support=0.004).collect()}
    assert got == {("q",): (1.0, pytest.approx(0.005))}  # p is on 3 of 1,000 pages


def test_tokens_that_always_go_together_are_one_item(spark):
    many = [f"t{i:02d}" for i in range(40)]
    rows = [([*many, "x"], True)] * 30 + [([*many, "x", "y"], True)] * 30 + [(["x"], False)] * 100 + [(["x", "y"], False)] * 40
    labelled = spark.createDataFrame(rows, "tokens array<string>, blocked boolean").repartition(6)
    classes = url_filter.mine_classes(labelled).collect()
    assert [r.classes for r in classes] == [[many]] and classes[0].confidence == 1.0
    assert {tuple(r.tokens) for r in url_filter.mine_rules(labelled).collect()} == {(t,) for t in many}
    pages = [(i, f"http://h{'' if i % 2 else '/' + '/'.join(many)}/{i}", i % 2 == 0) for i in range(400)]
    verdicts = judged(spark, [(i, u, int(t)) for i, u, t in pages])
    assert verdicts == {i: "block" if t else "allow" for i, _, t in pages}


def test_a_page_needs_one_token_of_each_class(spark):
    rows = [(i, "http://h.example" + ("/a/b" if i % 4 in (0, 1) else "") + ("/c/d" if i % 4 in (0, 2) else "") + f"/{i}", int(i % 4 == 0)) for i in range(800)]
    more = [(1000, "http://h.example/a/d/1"), (1001, "http://h.example/b/1"), (1002, "http://h.example/c/b/1")]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows] + more, "page_id long, url string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    got = {r.page_id: (r.verdict, r.mined) for r in url_filter.judge_urls(pages, labels, rules=()).collect()}
    assert got[1000] == ("block", "path:a path:d") and got[1001] == ("allow", None) and got[1002] == ("block", "path:b path:c") and got[0] == ("block", "path:a path:c")


def test_rules_of_the_real_table_equal_counts_of_all_combinations(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic IS NOT NULL").selectExpr("doc_id AS page_id", "toxic = 1 AS blocked")
    labelled = spark.read.parquet(f"{sf}/pages.parquet").join(labels, "page_id").select(url_filter.tokens_of(F.col("url")).alias("tokens"), "blocked")
    rows = [(frozenset(r.tokens), r.blocked) for r in labelled.collect()]
    parts = lambda tokens: (frozenset(c) for n in range(1, len(tokens) + 1) for c in itertools.combinations(sorted(tokens), n))
    hits = Counter(c for tokens, blocked in rows if blocked for c in parts(tokens))
    pages = Counter(c for tokens, _ in rows for c in parts(tokens) if c in hits)
    sure = {c: n / pages[c] for c, n in hits.items() if n >= url_filter.MIN_SUPPORT * len(rows) and n / pages[c] >= url_filter.MIN_CONFIDENCE}
    truth = {c: s for c, s in sure.items() if not any(d < c and sure[d] >= s for d in sure)}
    got = {frozenset(r.tokens): r.confidence for r in url_filter.mine_rules(labelled).collect()}
    assert truth and got == pytest.approx(truth)
    verdicts = url_filter.query(spark, sf).filter("mined IS NOT NULL AND rule IS NULL")
    assert verdicts.filter("verdict = 'block'").count() == verdicts.count() > 0
