"""The stages one after another, and the whole against plain versions of what SQL cannot express."""

import itertools
import os
import re
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark import storage
from tidemark.llm import decontaminate, exact_dedup, language_id, packing, simhash

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_decide(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SF)
        assert made.columns == columns
        made.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        before, after = ({r[0] for r in d.select("doc_id").collect()} for d in (docs, kept))
        assert after <= before
        docs_before, docs = docs, kept
        if name == "exact_dedup":
            marked = exact_dedup.exact_duplicates(docs_before).filter("kept")
            assert after == {r[0] for r in marked.select("doc_id").collect()}
        if name == "decontaminate":
            bad = decontaminate.contamination(docs_before, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated")
            assert before - after == {r[0] for r in bad.select("doc_id").collect()}
        if name == "language_id":
            assert not {r[0] for r in kept.filter("text IS NULL").collect()}
        if name == "simhash_near_dedup":
            assert simhash.near_duplicates(kept).filter("doc_id <> component_id").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def contaminated(text, windows):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    hit = {p for n in {len(w) for w in windows} for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in windows for p in range(i, i + n)}
    return bool(hit) and 20 * len(hit) >= len(words)


def test_run_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs.filter(~language_id.held_out()).select("text", "lang"))
    kept = {}
    for r in sorted(docs.collect()):
        language, score = model.predict(r.text)
        if language != "und" and score >= corpus_pipeline.MIN_LANGUAGE_SCORE:
            kept[r.text] = r.doc_id  # of equal texts the last
    kept = sorted((i, t) for t, i in kept.items())
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for i, t in kept}
    sets = {i: set(zip(*[w[k:] for k in range(5)], strict=False)) or {tuple(w)} for i, w in words.items()}
    label = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text or ""))
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} - {()}
    kept = {i: t for i, t in kept if label[i] == i and not contaminated(t, windows)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made = corpus_pipeline.run(spark, SF).toPandas()
    assert set(made["doc_id"]) == set(kept)
    for doc_id, pieces in made.sort_values("start").groupby("doc_id"):
        ids, at = np.array(tokenizer.encode(kept[doc_id], add_special_tokens=False).ids + [1], "<u4"), 0
        for p in pieces.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_letterless_documents_go(spark):
    docs = spark.createDataFrame([(1, "123 456", None), (2, None, None), (3, "the words of one", "en"), (4, "les mots de un", "fr")], "doc_id long, text string, lang string")
    assert {r.doc_id for r in language_id.keep_identified(docs, 0.35).collect()} == {3, 4}


def test_queries_built_side_by_side_keep_their_tables(spark):
    first = {"exact": exact_dedup.query(spark, SF), "pack": packing.query(spark, SF), "run": corpus_pipeline.run(spark, SF)}
    with ThreadPoolExecutor(2) as pool:
        others = [pool.submit(corpus_pipeline.run, spark, SF), pool.submit(exact_dedup.query, spark, SF)]
        others = [o.result() for o in others]
    counts = [df.count() for df in (others[0], first["run"], others[1], first["exact"], first["pack"])]
    assert counts[0] == counts[1] > 0 and counts[2] == counts[3] > 0 and counts[4] > 0


def test_a_scope_deletes_its_own_tables_alone(spark):
    files = lambda df: df.inputFiles()[0].removeprefix("file://")
    before = storage.materialise(spark.range(3), "before")
    with storage.scope(spark) as outer:
        with storage.scope(spark) as inner:
            made, kept = storage.materialise(spark.range(4), "made"), inner.keep(storage.materialise(spark.range(5), "kept"))
            gone = files(made)
        assert not os.path.exists(gone) and kept.count() == 5
        again = storage.materialise(spark.range(6), "again")
        outer.keep(again)
        held = files(kept)
    assert not os.path.exists(held) and again.count() == 6 and before.count() == 3
    storage.discard(before, before)


def test_exact_copies_of_rows_leave_one(spark):
    rows = [(1, "a", "en"), (1, "a", "en"), (1, "a", None), (0, "a", "en"), (None, None, "x"), (None, "", "x"), (2, "b", "en"), (3, "c", "z"), (3, "d", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(map(repr, map(tuple, exact_dedup.drop_exact_duplicates(docs).collect())))
    assert got == sorted(map(repr, [(1, "a", None), (None, None, "x"), (2, "b", "en"), (3, "c", "z"), (3, "d", "z")]))
