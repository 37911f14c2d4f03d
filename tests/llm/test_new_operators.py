"""Byte-level BPE, resampling and whitening against plain versions, and on awkward tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, resampling, whitening

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return dict(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.tokenizer(public_tokenizers.path(byte_bpe.VOCABULARY)).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_merge(piece, ranks):
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_as_a_plain_version_whatever_the_ranks():
    rng = random.Random(2)
    for _ in range(300):
        tokens = list({*(bytes([c]) for c in b"abc"), *(bytes(rng.choices(b"abc", k=rng.randint(2, 6))) for _ in range(30))})
        rng.shuffle(tokens)  # a longer token's rank may be below its parts'
        bpe = byte_bpe.ByteBpe({t: i for i, t in enumerate(tokens)})
        for _ in range(10):
            piece = bytes(rng.choices(b"abc", k=rng.randint(1, 60)))
            assert bpe.merge(piece) == plain_merge(piece, bpe.ranks)
            assert not bpe._buckets and not any(bpe._leaves)


def test_ids_are_the_librarys(spark, texts, library):
    rng = random.Random(3)
    odd = ["", " ", "\n\n \t", "<|endoftext|>", "a" * 30_000, "".join(rng.choices("abcdefgh", k=20_000)), "你好" * 3000, " " * 5000 + "x", "\x00\x01é\U0001f600 it's 12'll"]
    odd += ["".join(chr(rng.choice([rng.randrange(128), rng.randrange(0xD7FF), rng.randrange(0x10000, 0x110000)])) for _ in range(300)) for _ in range(50)]
    docs = {**texts, **{-1 - i: t for i, t in enumerate(odd)}}
    made = byte_bpe.decode_documents(byte_bpe.encode_documents(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))).collect()
    assert len(made) == len(docs)
    for r in made:
        assert r.ids == library.encode_ordinary(docs[r.doc_id] or "") and bytes(r.data) == (docs[r.doc_id] or "").encode()


def test_words_are_cut_as_the_pattern_cuts(library):
    bpe = byte_bpe.tokenizer(public_tokenizers.path(byte_bpe.VOCABULARY))
    rng = random.Random(6)
    signs = [" ", " ", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "\u200b", "a", "b", "it's", "'ll", "1", "é", ",", "!?", "\U0001f600"]
    for _ in range(20_000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 9)))
        assert bpe.encode(text).tolist() == library.encode_ordinary(text), repr(text)


def test_bpe_query(spark, texts, library):
    for r in byte_bpe.query(spark, SF).collect():
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_bpe_remembers_a_bounded_number(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    bpe = byte_bpe.ByteBpe(byte_bpe.tokenizer(public_tokenizers.path(byte_bpe.VOCABULARY)).ranks)
    text = "one two three four five six two one seven " * 20
    assert bpe.encode(text).tolist() == library.encode_ordinary(text) and max(map(len, (bpe._pieces, bpe._words, bpe._spaced))) <= 3


def test_bpe_query_has_one_python_worker_a_task_and_small_batches(spark, library):
    docs = spark.createDataFrame([(i, f"row {i} lorem" if i % 7 else None) for i in range(1000)], "doc_id long, text string").coalesce(1)
    both = byte_bpe.encode_and_decode(docs)
    assert sorted(map(repr, both.collect())) == sorted(map(repr, byte_bpe.decode_documents(byte_bpe.encode_documents(docs)).collect()))
    assert all(r.ids == library.encode_ordinary(bytes(r.data).decode()) for r in both.collect())
    plan = byte_bpe.query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and max(p.num_rows for p in byte_bpe._parts(pa.record_batch({"x": list(range(n))}) for n in (0, 1000))) == byte_bpe.ROWS


SCHEMA = "doc_id long, text string, ids string, words string, features int, rank string, tie int, part int, score string, data string, id int, n int"
ROWS = [(1, "A b c"), (2, None), (3, ""), (None, "word " * 25), (5, "lorem ipsum " * 60_000), (5, "lorem ipsum " * 60_000), (6, " \n."), (7, "\x00 éÉ 1"), (None, None), (8, "A b c")]


def awkward(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", 1, "x", 1, 1, "x", "x", 1, 1) for i, t in rows], SCHEMA)


def test_bpe_on_awkward_tables(spark, library):
    made = byte_bpe.decode_documents(byte_bpe.encode_documents(awkward(spark, ROWS)))
    assert sorted(((r.doc_id or 0), tuple(r.ids)) for r in made.collect()) == sorted(((i or 0), tuple(library.encode_ordinary(t or ""))) for i, t in ROWS)
    assert byte_bpe.decode_documents(byte_bpe.encode_documents(awkward(spark, []))).count() == 0
    gone = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.data) for r in byte_bpe.decode_documents(gone).collect()] == [b"", b""]


def plain_resample(docs, target, percent, least, order, buckets, seed=2024):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return words, [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in side for f in features(x)[1]) for side in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        words, own = features(text)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    may = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(may[: percent * len(may) // 100])}
    return sorted((tuple(r[:4]) + (rank.get(id(r)),) for r in rows), key=repr)


@pytest.mark.parametrize(("order", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (2, 64, 35, 3), (3, 1000, 100, 0)])
def test_resampling_equals_a_plain_version(spark, texts, order, buckets, percent, least, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK_ENTRIES", 500)
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    docs = [*texts.items(), *ROWS[:5], *ROWS[6:]]
    made = resampling.resample(awkward(spark, docs), bench, percent, least, order=order, buckets=buckets)
    assert made.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, made.collect()), key=repr) == plain_resample(docs, target, percent, least, order, buckets)


def test_resampling_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    frame = con.execute(resampling.ORACLE_SQL).fetchdf()
    made = resampling.query(spark, SF).toPandas()
    key = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).to_numpy().tolist()))
    whole = lambda f: f.assign(rank=f["rank"].astype("Int64"))
    assert len(made) > 0 and key(whole(made)) == key(whole(frame))


def test_resampling_on_awkward_tables(spark):
    bench = spark.createDataFrame([(1, "lorem"), (None, None)], "item_id long, text string")
    made = resampling.resample(awkward(spark, ROWS), bench, percent=100)
    assert sorted(r["rank"] for r in made.collect() if r["rank"]) == [1, 2, 3]  # of two equal rows each
    assert resampling.resample(awkward(spark, []), bench).count() == 0
    alone = resampling.resample(awkward(spark, ROWS), bench.limit(0), percent=0)
    assert alone.count() == len(ROWS) and alone.filter("rank IS NOT NULL").count() == 0


def test_matrix_is_stored_in_small_parts(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(20_000)]
    docs = spark.createDataFrame([(i, " ".join(rng.sample(vocabulary, 300))) for i in range(9000)], "doc_id long, text string").coalesce(1)
    blocks = resampling.matrix(docs)
    sizes = [r[0] for r in blocks.select(F.size("columns")).collect()]
    assert max(sizes) < (1 << 14) + 10_000 and sum(sizes) > 2_000_000
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.inputFiles()]
    # of a file's rows a reader decodes a group at a time
    assert max(m.row_group(k).num_rows for m in groups for k in range(m.num_row_groups)) <= 110 < len(sizes)


def test_jacobi_finds_small_eigenvalues():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        q, _ = np.linalg.qr(rng.standard_normal((n, n)))
        a = q * np.logspace(0, -6, n) @ q.T
        a = (a + a.T) / 2
        values, vectors = whitening.jacobi(a)
        assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1], rtol=1e-8, atol=0)
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13 and np.abs(a @ vectors - vectors * values).max() < 1e-14
    # a graded matrix, whose least eigenvalue a method with absolute errors would miss
    d = np.diag(10.0 ** -np.arange(0, 12, 2.0))
    a = d @ (np.eye(6) + 0.1) @ d
    values, _ = whitening.jacobi(a)
    exact = np.linalg.det(np.eye(6) + 0.1) * np.prod(np.diag(d) ** 2)
    assert abs(np.prod(values) / exact - 1) < 1e-12


def plain_whitening(vectors, k=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = (x * n - sums) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(k, int((values > 1e-13 * np.trace(cov)).sum()))
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, centred @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / np.trace(cov)


def compare(made, ids, vectors, k=32):
    n, deviation, whitened, explained = plain_whitening(vectors, k)
    got: dict = {}
    for r in made.collect():
        assert r.n == n and r.identity_error < 1e-10
        got.setdefault((r.vec_id, r.component), []).append((r.deviation, r.whitened, r.explained))
    assert len(got) == len(set(ids)) * whitened.shape[1]
    sign = {}
    for row, i in enumerate(ids):
        for c in range(whitened.shape[1]):
            dev, value, share = got[i, c + 1][0]
            if abs(whitened[row, c]) > 1e-3:
                assert sign.setdefault(c, np.sign(value * whitened[row, c])) == np.sign(value * whitened[row, c])
            assert dev == deviation[row] and abs(abs(value) - abs(whitened[row, c])) < 1e-6 and abs(share / explained[c] - 1) < 1e-8


def test_whitening_equals_a_plain_version(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    compare(whitening.query(spark, SF), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_whitening_on_awkward_tables(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((60, 3)) * [100, 1, 0.2] + 5).tolist()
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 1.0, 2.0]), (104, []), (105, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>, n int, deviation string, whitened string, component int, vector int, place int"
    some = spark.createDataFrame([(i, v, 1, "x", "x", 1, 1, 1) for i, v in [*enumerate(vectors), *bad]], schema)
    compare(whitening.whiten(some), list(range(60)), vectors)
    compare(whitening.whiten(some, components=2), list(range(60)), vectors, 2)
    assert whitening.whiten(some.filter("vec_id >= 100 AND vec_id < 105")).count() == 0
    assert whitening.whiten(some.limit(0)).count() == 0
    same = spark.createDataFrame([(None, [1.0, 2.0])] * 3, "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0
    # one dimension without variance has no component
    flat = spark.createDataFrame([(i, [float(i), 7.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(flat).count() == 5
    huge = spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert [r.deviation for r in whitening.whiten(huge).orderBy("vec_id").collect()] == [None, None, 0]


def test_whitening_of_repeated_vectors(spark):
    rows = [r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()][:120]
    rows += [rows[0]] * 60
    made = whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<float>").repartition(7))
    compare(made, list(range(len(rows))), rows)


def test_vocabulary_file_is_read_as_is():
    with open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb") as lines:
        first = next(iter(lines)).split()
    assert byte_bpe.tokenizer(public_tokenizers.path(byte_bpe.VOCABULARY)).ranks[base64.b64decode(first[0])] == int(first[1])


def test_scores_of_rows_that_share_an_id_are_equal(spark):
    docs = awkward(spark, [(1, "a b"), (1, "a b"), (1, "c")])
    made = resampling.resample(docs, docs.select("doc_id", "text"), percent=100, least_words=1)
    assert made.select(F.col("score") - F.col("weight")).distinct().count() == 1 and sorted(r["rank"] for r in made.collect()) == [1, 2, 3]
