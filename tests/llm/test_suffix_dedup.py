"""The steps of the repeat removal give few rows, whatever the batches."""

import os

import numpy as np
import pyarrow as pa
import pytest

from tidemark import storage
from tidemark.llm import repeats, suffix_dedup


def test_anchors_of_many_texts_are_those_of_each(monkeypatch):
    rng = np.random.default_rng(5)
    for piece in (300, 1000, repeats.PIECE):
        monkeypatch.setattr(repeats, "PIECE", piece)
        for _ in range(10):
            texts = [rng.integers(97, 100, n).astype(np.uint8) for n in rng.choice([0, 1, 31, 32, 99, 100, 101, 168, 3000], 8)]
            offsets = np.cumsum([7, *map(len, texts)])
            got = repeats.text_anchors(np.concatenate([np.full(7, 97, np.uint8), *texts]), offsets)
            want = [(k, *row) for k, text in enumerate(texts) for row in zip(*(v.tolist() for v in repeats.anchors(text)), strict=True)]
            assert list(zip(*(v.tolist() for v in got), strict=True)) == want


def context_batch(rows: list[bytes]) -> pa.RecordBatch:
    n = len(rows)
    columns = [np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64), np.full(n, 500), np.full(n, repeats.BEFORE * 256 + repeats.WINDOW)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(rows, pa.binary())], ["h", "doc_id", "hash", "a", "b", "context"])


def test_a_context_gives_one_span(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(suffix_dedup, "BATCH_MEMBERS", 7, raising=False)
    for _ in range(10):
        base = rng.integers(97, 123, repeats.CONTEXT).astype(np.uint8)
        rows = []
        for _ in range(40):
            row = base.copy()
            row[rng.choice(repeats.BEFORE, 1)] = rng.integers(97, 123)
            row[rng.integers(repeats.BEFORE + repeats.GRAM, repeats.CONTEXT)] = rng.integers(97, 123)
            rows.append(row.tobytes())
        want = {}
        for before in range(repeats.BEFORE + 1):
            seen, at = set(), repeats.BEFORE - before
            for k, row in enumerate(rows):
                window = row[at : at + repeats.WINDOW]
                if window in seen:
                    begin, end = want.get(k, (500, 500))
                    want[k] = min(begin, 500 - before), max(end, 500 - before + repeats.WINDOW)
                seen.add(window)
        spans = [tuple(r.values()) for b in suffix_dedup._repeat_spans([context_batch(rows)]) for r in b.select(["doc_id", "a", "b"]).to_pylist()]
        assert sorted(spans) == sorted((k, *v) for k, v in want.items())


def test_copies_within_a_batch_give_one_span_each():
    rng = np.random.default_rng(7)
    text = bytes(rng.integers(97, 123, 5000).astype(np.uint8)).decode()
    batch = pa.RecordBatch.from_arrays([pa.array([3, 1, 2]), pa.array([9, 9, 9]), pa.array([text] * 3)], ["doc_id", "hash", "text"])
    rows = [r for b in suffix_dedup._anchors([batch]) for r in b.to_pylist() if r["kind"] == suffix_dedup.SPAN]
    assert sorted((r["doc_id"], r["a"], r["b"]) for r in rows) == [(2, 0, 5000), (3, 0, 5000)]


def test_anchors_of_one_repeated_byte_are_dealt_in_parts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_ANCHORS", 1000, raising=False)
    monkeypatch.setattr(repeats, "PIECE", 500)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([9, 9]), pa.array(["a" * 6000, "a" * 6000])], ["doc_id", "hash", "text"])
    held = []
    dealt = suffix_dedup._dealt
    monkeypatch.setattr(suffix_dedup, "_dealt", lambda rows: held.append(sum(len(r[0]) for r in rows)) or dealt(rows))
    list(suffix_dedup._anchors([batch]))
    assert sum(held) == 2 * (6000 - repeats.GRAM + 1) and max(held) < 1500


def test_merged_spans_go_on_in_later_batches():
    rng = np.random.default_rng(8)
    rows = sorted((int(d), int(h), int(a), int(a + n)) for d, h, a, n in zip(*(rng.integers(0, m, 400) for m in (6, 2, 900)), rng.integers(1, 9, 400), strict=True))
    want: dict = {}
    for d, h, a, b in rows:
        spans = want.setdefault((d, h), [])
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    for size in (1, 3, 50, 400):
        parts = [rows[i : i + size] for i in range(0, 400, size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], ["doc_id", "hash", "a", "b"]) for part in parts]
        got = [r for b in suffix_dedup._merged(batches) for r in b.to_pylist()]
        assert {(r["doc_id"], r["hash"]): [list(x) for x in zip(r["starts"], r["stops"], strict=True)] for r in got} == want
        assert len(got) == len(want) and all(r["n"] == len(r["starts"]) for r in got)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_CONTEXTS, 2])
def test_only_the_merged_spans_outlive_the_search(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    rng = np.random.default_rng(9)
    line = "".join(rng.choice(list("abcd"), 120))
    docs = spark.createDataFrame([(k, "".join(rng.choice(list("abcd"), 80)) + line + "".join(rng.choice(list("abcd"), 80))) for k in range(5)], "doc_id long, text string")
    before = set(os.listdir(storage.shared_folder(spark)))
    assert sorted(r.n_removed for r in suffix_dedup.remove_repeats(docs).collect())[:2] == [0, 120]
    assert {x.split("-")[0] for x in set(os.listdir(storage.shared_folder(spark))) - before} == {"merged"}
