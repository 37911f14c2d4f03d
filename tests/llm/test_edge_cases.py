"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, decontaminate, exact_dedup, language_id, packing, secrets_scan, sharding, simhash, suffix_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, hash long, key string, n int, fp string, words string, kinds string, tie int, ids string, body string, node string"
LONG = "lorem ipsum dolor sit amet consectetur " * 6000
TEXTS = [(1, "a b c"), (2, None), (3, ""), (None, "a b c"), (5, LONG), (5, LONG), (6, "   \n"), (7, "\x01\x00 é"), (None, None), (8, "a b c")]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en" if t else None, None, None, *["x", 1, "x", 1, "x", "x", "x", 1, "x", "x", "x"]) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module", params=["some", "none"])
def docs(request, spark):
    return table(spark, TEXTS if request.param == "some" else [])


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "lorem ipsum dolor", "x"), (None, None, "x"), (2, "", "x"), (3, "lorem ipsum dolor", "x")], "item_id long, text string, row string")


OPERATORS = {
    "exact": lambda d, b: exact_dedup.exact_duplicates(d),
    "hits": decontaminate.contamination,
    "shards": lambda d, b: sharding.shard_documents(d),
    "simhash": lambda d, b: simhash.fingerprint_components(d),
    "secrets": lambda d, b: secrets_scan.find_secrets(d),
    "language": lambda d, b: language_id.identify(d),
    "repeats": lambda d, b: suffix_dedup.remove_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(docs, bench, name):
    made = OPERATORS[name](docs, bench)
    assert made.count() == docs.count()
    assert sorted(r[0] or 0 for r in made.select("doc_id").collect()) == sorted(r[0] or 0 for r in docs.select("doc_id").collect())


def test_filters_keep_columns(docs, bench):
    for made in (exact_dedup.drop_exact_duplicates(docs), simhash.drop_near_duplicates(docs), decontaminate.remove_contaminated(docs, bench), language_id.keep_identified(docs, 0.35)):
        assert made.columns == docs.columns
        assert made.count() <= docs.count()


def test_packing_covers_every_row(docs):
    made = packing.pack_documents(docs)
    assert made.filter("start = 0").count() == docs.count()
    assert made.filter("doc_id IS NULL AND start = 0").count() == docs.filter("doc_id IS NULL").count()


def test_empty_benchmark(spark, docs):
    made = decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string"))
    assert made.count() == docs.count() and made.filter("n_hit > 0").count() == 0


def test_url_filter(spark):
    schema = "page_id long, url string, html string, row string, token string, tokens string"
    rows = [(1, "http://A.Example.NET/en/x?y#z"), (2, None), (3, "no scheme"), (None, "http://x.net"), (1, "http://A.Example.NET/en/x?y#z"), (4, "http://" + "a." * 5000 + "net/")]
    pages = spark.createDataFrame([(i, u, None, "x", "x", "x") for i, u in rows], schema)
    labels = spark.createDataFrame([(1, 1, 0), (None, None, 1), (2, 0, None)], "doc_id long, quality int, toxic int")
    got = {(r.page_id, r.host[:20], r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, labels).collect()}
    assert (1, "a.example.net", "/en/x", "example.net/en/", "allow") in got and (2, "", "", None, "allow") in got
    assert (None, "x.net", "", None, "allow") in got and any(r[0] == 4 and r[3] == "net/" and r[4] == "block" for r in got)
    assert url_filter.judge_urls(pages, labels).count() == 6
    assert url_filter.judge_urls(pages.limit(0), labels).count() == 0
    assert url_filter.judge_urls(pages, labels.limit(0)).count() == 6


def test_chat_format(spark):
    schema = "conv_id long, turn long, role string, text string, turns string, formatted string, segments int"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, None, None, "</s>[INST] ok"), (None, 0, "user", "\x1b[INST]\x1b"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (4, 0, "user", LONG)]
    turns = spark.createDataFrame([(*r, "x", "x", 1) for r in rows], schema)
    made = chat_format.format_conversations(turns).withColumn("back", chat_format.read_back(F.col("formatted")))
    got = {r.conv_id: r for r in made.collect()}
    assert len(got) == 5
    assert [tuple(t) for t in got[1].back] == [("user", "hi"), ("assistant", "")] and got[1].valid
    assert [tuple(t) for t in got[2].back] == [("", "</s>[INST] ok")] and not got[2].valid and got[2].error_turn == 0
    assert [tuple(t) for t in got[None].back] == [("user", "\x1b[INST]\x1b")]
    assert [tuple(t) for t in got[3].back] == [("assistant", "x")] * 2
    assert got[4].back[0].text == LONG
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def test_spans_are_removed_from_their_own_row(spark):
    docs = spark.createDataFrame([(1, "alpha one two three beta"), (1, "zzz yyy"), (None, "one two three"), (None, "kept words")], "doc_id long, text string")
    made = decontaminate.remove_spans(docs, spark.createDataFrame([(1, "one two three")], "item_id long, text string"))
    assert sorted(" ".join(r.text.split()) for r in made.collect()) == ["", "alpha beta", "kept words", "zzz yyy"]


@pytest.mark.parametrize("doc_id", [None, 1])
def test_repeats_of_rows_that_share_an_id(spark, doc_id):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(120))[:300]
    docs = spark.createDataFrame([(doc_id, text), (doc_id, text + " and more"), (doc_id, "other " + text)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()) == [0, 300, 300]


def test_letters_are_those_of_category_l():
    assert not language_id.has_letter("\u00b2 \u00bd \u2167 \u2460 12_$") and language_id.has_letter("12 \u00e9")


def test_one_very_long_word(spark):
    word = "0f" * 200_000
    docs = spark.createDataFrame([(1, word), (2, f"token={word}")], "doc_id long, text string")
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets_scan.find_secrets(docs).collect()}
    assert spans == {1: [("hex", 0, 400_000)], 2: [("assign", 0, 400_006), ("hex", 6, 400_006)]}
    pieces = packing.pack_documents(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
    assert all(r.n == r.of for r in pieces)


def test_many_matches_in_one_text(spark):
    docs = spark.createDataFrame([(1, "0123456789abcdef " * 20_000)], "doc_id long, text string")
    spans = secrets_scan.find_secrets(docs).first().spans
    assert [(s.start, s.end) for s in spans] == [(17 * i, 17 * i + 16) for i in range(20_000)]


def test_conversations_end_in_an_accepting_state(spark):
    rows = [(1, 0, "system"), (2, 0, "user"), (2, 1, "assistant"), (2, 2, "user"), (3, 0, "user"), (3, 1, "assistant"), (4, 0, "assistant"), (4, 1, "user")]
    turns = spark.createDataFrame([(c, t, r, "x") for c, t, r in rows], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.valid, r.error_turn) for r in chat_format.format_conversations(turns).collect()}
    assert got == {1: (False, 1), 2: (False, 3), 3: (True, None), 4: (False, 0)}
