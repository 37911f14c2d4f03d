"""Exact deduplication by counting quotient filters and byte verification.

Each partition counts its texts' 64-bit fingerprints in a counting quotient
filter, cut into blocks. A block's filters from all partitions merge by sorted
remainders, without loss. Texts whose fingerprint counts one are single and go no
further; the others are compared byte by byte, by grouping on the text itself,
which Spark combines within each partition before it shuffles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quotient_filter as cqf
from .common import lookup, materialise, measured, sized, table

#: Fingerprints that a block of the filter is meant to hold.
BLOCK_FINGERPRINTS = 1 << 17


def _build(block_bits: int):
    def build(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            rows += len(held[-1])
            if rows >= 4_000_000:  # a bounded part of the partition at a time
                yield from _blocks(np.concatenate(held), block_bits)
                held, rows = [], 0
        if rows:
            yield from _blocks(np.concatenate(held), block_bits)

    return build


def _blocks(fingerprints: np.ndarray, block_bits: int):
    found, counts = cqf.counted(fingerprints)
    block = cqf.block_of(found, block_bits)
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    for some in range(0, len(starts), 2048):
        ids, data = [], []
        for k in range(some, min(some + 2048, len(starts))):
            a, b = starts[k], starts[k + 1] if k + 1 < len(starts) else len(found)
            ids.append(int(block[a]))
            data.append(cqf.encode(found[a:b], counts[a:b], block_bits))
        yield pa.RecordBatch.from_pydict({"block": pa.array(ids, pa.int64()), "filter": pa.array(data, pa.binary())})


def _merge(block_bits: int):
    def merge(key, parts):
        found, counts = cqf.merge(parts.column("filter").to_pylist(), key[0].as_py(), block_bits)
        more = counts > 1
        return pa.table({"fp": pa.array(found[more].view(np.int64)), "seen": pa.array(counts[more])})

    return merge


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp, seen) of the values of the one long column that occur more than once."""
    block_bits = max(7, math.ceil(math.log2(max(1, rows) / BLOCK_FINGERPRINTS)))
    filters = fingerprints.mapInArrow(_build(block_bits), "block long, filter binary")
    return filters.groupBy("block").applyInArrow(_merge(block_bits), "fp long, seen long")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and are equal to empty ones. Of equal texts the row
    with the largest id stays; a null id is below all others, and keep_id is null
    if the group has no other. Rows that repeat both id and text get the same
    result, each of them. Empty tables give no rows. Other columns are ignored,
    so their names cannot clash.
    """
    body = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), body.alias("body")).withColumn("fp", F.xxhash64("body"))
    keyed = rows.select("doc_id", "fp", F.sha2("body", 256).alias("text_sha256"))
    repeated = materialise(repeated_fingerprints(rows.select("fp"), docs.count()), "repeated")
    suspects = rows.join(sized(repeated.select("fp"), repeated), "fp")
    verified = (
        suspects.groupBy("fp", "body")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        .select("fp", F.sha2("body", 256).alias("text_sha256"), "keep_id", "n")
        .groupBy("fp", "text_sha256")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
        # two texts of one SHA-256 would be a find; they are not merged in silence
        .withColumn("n", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts have one SHA-256")).cast("long")).otherwise(F.col("n")))
        .drop("texts")
    )
    classes = materialise(verified, "classes")
    joined = lookup(keyed, classes, ["fp", "text_sha256"])
    single = F.col("n").isNull()
    return joined.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce(F.col("n"), F.lit(1)).cast("long").alias("group_size"),
        F.when(single, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; see exact_duplicates for which, nulls and ties.

    Of rows that repeat both id and text one stays, that whose other columns are
    least, nulls first. Empty tables stay empty.
    """
    copies = exact_duplicates(docs).filter("group_size > 1").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha"), "kept")
    decided = materialise(copies.groupBy("_id", "_sha", "kept").agg(F.count(F.lit(1)).alias("_rows")), "decided")
    sha = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    dropped = sized(decided.filter("NOT kept OR _rows > 1"), decided)
    stay = docs.join(dropped, docs["doc_id"].eqNullSafe(dropped["_id"]) & (sha == dropped["_sha"]), "left_anti")
    if not measured(decided, "_rows") or decided.filter("kept AND _rows > 1").isEmpty():
        return stay
    repeats = sized(decided.filter("kept AND _rows > 1").select("_id", "_sha"), decided)
    same = docs.join(repeats, docs["doc_id"].eqNullSafe(repeats["_id"]) & (sha == repeats["_sha"]))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = same.groupBy("_id", "_sha").agg(F.min(row).alias("row")).select("row.*")
    return stay.unionByName(one)


QUERY = "op2_exact_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
