"""Importance resampling towards a target distribution, over a stored sparse matrix.

Documents become rows of a sparse matrix: how often each hashed bucket's features
occur. It is stored as blocks of compressed sparse rows. Column sums give the
buckets' distribution in the corpus, those of the target's matrix that of the
target. A bucket's gain is the logarithm of the ratio of the two, and the matrix
times the gains gives each document's weight. Adding Gumbel noise to the weights
and taking the highest draws without replacement, by weight.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, measured, sized, table, tasks_for

#: Features are runs of 1 to ORDER words.
ORDER, BUCKETS = 1, 10_000
SEED, PERCENT, LEAST_WORDS = 2024, 10, 20
#: Rows and entries at which a block of the matrix is closed, and bytes at which its row group is. A reader decodes a row group whole,
#: and entries take many times their bytes in the file, so both are small.
BLOCK_ROWS, BLOCK_ENTRIES, GROUP_BYTES = 1024, 1 << 14, 1 << 20
#: Texts of a batch that a task turns into words at a time.
TEXTS = 256
#: Bytes of scores meant for a task that ranks.
TASK_BYTES = 32 << 20

_FOLD = bytes(b if 0x30 <= b < 0x3A or 0x61 <= b < 0x7B or b >= 0x80 else b + 0x20 if 0x41 <= b < 0x5B else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8: runs of digits, letters a-z and characters beyond ASCII, A-Z lower-cased."""
    return text.encode().translate(_FOLD).split()


def row_of(words: list[bytes], order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(buckets, counts, features) of a document: a row of the matrix, sorted by bucket."""
    seen = Counter(words)
    for n in range(2, order + 1):
        seen.update(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    if not seen:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), 0
    bucket = np.fromiter((zlib.crc32(f) % buckets for f in seen), np.int64, len(seen))
    count = np.fromiter(seen.values(), np.int64, len(seen))
    at, where = np.unique(bucket, return_inverse=True)
    sums = np.bincount(where, weights=count).astype(np.int64)
    return at.astype(np.int32), sums.astype(np.int32), int(sums.sum())


_BLOCK = "words array<long>, features array<long>, starts array<int>, columns array<int>, counts array<int>"


def matrix(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The document-by-bucket matrix in blocks of compressed sparse rows, stored.

    A block: ids, words and features of its documents, starts (where each row's
    entries begin, and the end), columns and counts. A null text has no words, so its
    row is empty. Blocks, row groups and the texts in hand are bounded, so a task's
    memory does not grow with the table.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        ids, made, entries = [], [], 0  # the open block: copies of its ids, and each row's (buckets, counts, features, words)

        def closed():
            one = lambda xs, t: pa.array([xs], pa.list_(t))
            joined = lambda k: np.concatenate([np.zeros(0, np.int32), *(m[k] for m in made)])
            starts = np.cumsum([0, *(len(m[0]) for m in made)])
            own = pa.ListArray.from_arrays(pa.array([0, len(made)], pa.int32()), pa.concat_arrays(ids))
            columns = [own, one([m[3] for m in made], pa.int64()), one([m[2] for m in made], pa.int64()), one(starts, pa.int32()), one(joined(0), pa.int32()), one(joined(1), pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["ids", "words", "features", "starts", "columns", "counts"])

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                first = at  # of the rows whose ids are not in the open block yet
                for i, text in enumerate(batch.column(1).slice(at, TEXTS).to_pylist(), at):
                    words = words_of(text or "")
                    made.append((*row_of(words, order, buckets), len(words)))
                    entries += len(made[-1][0])
                    if len(made) >= BLOCK_ROWS or entries >= BLOCK_ENTRIES:
                        ids.append(batch.column(0).take(pa.array(range(first, i + 1))))
                        yield closed()
                        ids, made, entries, first = [], [], 0, i + 1
                # a copy, as a slice would hold the batch's texts
                ids.append(batch.column(0).take(pa.array(range(first, min(at + TEXTS, batch.num_rows)), pa.int64())))
        if made:
            yield closed()

    return materialise(rows.mapInArrow(run, f"ids array<{kind}>, {_BLOCK}"), "matrix", group_bytes=GROUP_BYTES)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the buckets that occur; each task adds its blocks up before anything is shuffled."""

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                columns, counts = (batch.column(c).slice(k, 1).flatten().to_numpy() for c in (0, 1))
                np.add.at(sums, columns, counts)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], ["bucket", "n"])

    return blocks.select("columns", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, from the column sums of both matrices: floor(1000 ln of the ratio of shares, one added to each count)."""
    spark = corpus.sparkSession
    totals = lambda df, name: F.broadcast(df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name)))  # noqa: E731  one row
    both = (
        spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        .join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
        .join(totals(corpus, "all_s")).join(totals(target, "all_t"))
    )
    plus = lambda c, k: F.coalesce(F.col(c), F.lit(0)).cast("double") + F.lit(float(k))
    ratio = (plus("t", 1) * plus("all_s", buckets)) / (plus("s", 1) * plus("all_t", buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) by the matrix times the gains: the mean gain of a document's features, rounded down; 0 without any."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            made = [np.zeros(0, np.int64)]
            for k in range(batch.num_rows):
                features, starts, columns, counts = (batch.column(c).slice(k, 1).flatten().to_numpy() for c in range(2, 6))
                running = np.r_[0, np.cumsum(gain[columns] * counts)]
                product = running[starts[1:]] - running[starts[:-1]]
                made.append(np.where(features > 0, product // np.maximum(features, 1), 0))
            ids, words, features = (batch.column(c).flatten() for c in range(3))
            yield pa.RecordBatch.from_arrays([ids, words, features, pa.array(np.concatenate(made), pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of the SHA-256 of seed:key; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, order: int = ORDER, buckets: int = BUCKETS
) -> DataFrame:
    """One row for each row of docs: doc_id, n_features, weight, score, rank.

    Of the documents with at least so many words, percent of them, rounded down, are
    drawn: those of highest score, ties to the smaller id, null ids first; rank
    counts them from 1 and is null for others. Rows that repeat an id have the same
    noise and are drawn each, in the order of a stored tie-break. Null and empty
    texts have no features, weight 0, and are never drawn. An empty target has equal
    shares in all buckets; an empty table gives no rows. Other columns are ignored,
    so their names cannot clash. The driver holds a gain for each bucket.
    """
    blocks = matrix(docs, order, buckets)
    found = gains(column_sums(blocks, buckets), column_sums(matrix(target, order, buckets, target.columns[0]), buckets), buckets)
    gain = np.zeros(buckets, np.int64)
    for bucket, value in found.collect():  # one row for each bucket
        gain[bucket] = value
    scored = weights(blocks, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    may = F.col("n_words") >= least_words
    scored = materialise(scored.withColumn("tie", F.monotonically_increasing_id()), "scores", may=F.count(F.when(may, 1)))
    drawn = (measured(scored, "may") or 0) * percent // 100
    # ranks without a task for all rows: range-sorted parts, counted, then numbered each by itself
    order_by = [F.desc("score"), F.asc("doc_id"), F.asc("tie")]
    parts = scored.filter(may).repartitionByRange(tasks_for(scored, TASK_BYTES), *order_by).withColumn("part", F.spark_partition_id())
    parts = materialise(parts, "ranges")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = materialise(parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before")), "offsets")
    # whole parts beyond the draw need no numbers
    near = parts.join(sized(offsets.filter(F.col("before") < drawn), offsets), "part")
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order_by))
    numbered = near.withColumn("rank", place.cast("long"))
    far = parts.join(sized(offsets.filter(F.col("before") >= drawn).select("part"), offsets), "part", "left_semi").withColumn("rank", F.lit(None).cast("long"))
    short = scored.filter(~may).withColumn("rank", F.lit(None).cast("long"))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return numbered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select(*out).unionByName(far.select(*out)).unionByName(short.select(*out))


QUERY = "op12_resampling"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_HEX = lambda i: f"(instr('0123456789ABCDEF', substr(h, {i}, 1)) - 1)"

#: CRC-32 by its table of 256 remainders, byte by byte.
ORACLE_SQL = rf"""
WITH crcs AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)),
told AS (SELECT 'd' AS side, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words, doc_id FROM documents
  UNION ALL SELECT 't', row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), NULL FROM benchmark),
each AS (SELECT side, row, unnest(words) AS word FROM told),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM each)),
bytes AS (SELECT word, list_transform(range(1, CAST(length(h) AS BIGINT), 2), lambda i: {_HEX('i')} * 16 + {_HEX('i + 1')}) AS bs FROM hexed),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, bs), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM bytes, crcs),
cells AS (SELECT side, row, bucket, count(*) AS n FROM each JOIN hashed USING (word) GROUP BY ALL),
sums AS (SELECT bucket, sum(n) FILTER (WHERE side = 'd') AS s, sum(n) FILTER (WHERE side = 't') AS t FROM cells GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS al, coalesce(sum(t), 0) AS bl FROM sums),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(al + {BUCKETS} AS DOUBLE) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(bl + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain FROM sums, totals),
summed AS (SELECT row, sum(n * gain) AS product FROM cells JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row),
scored AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(CASE WHEN len(words) > 0 THEN floor(CAST(product AS DOUBLE) / len(words)) ELSE 0 END AS BIGINT) AS weight,
    CAST(('0x' || left(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8)) AS BIGINT) AS h
  FROM told LEFT JOIN summed USING (row) WHERE side = 'd'),
placed AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score, n_features >= {LEAST_WORDS} AS may FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS k, {PERCENT} * count(*) OVER (PARTITION BY may) // 100 AS drawn FROM placed)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND k <= drawn THEN k END AS rank FROM ranked
"""
