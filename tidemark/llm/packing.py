"""Packing documents into sequences along a space-filling curve.

A document's tokens vote with fixed pseudo-random signs in a few dimensions; the
direction of the sum, on a grid, gives a Hilbert key. Documents are range-sorted by
key, so neighbours on the curve, which are alike, lie together. Each range is cut
into full sequences; the tokens that are left at the ends of all ranges are packed
in a second pass, the last of them in sequences of powers of two, so nothing is padded.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, tasks_for

SEQUENCE, END = 2048, 1
DIMENSIONS, GRID_BITS = 4, 8
#: Bytes of ids meant for a range, which one task packs.
TASK_BYTES = 32 << 20
#: Ranges whose tails, of less than a sequence each, one task packs.
RANGES_PER_TAIL_TASK = 1000
#: The ranks of byte_bpe_50k.json; this encoder gives the same ids in a quarter of the time (a test compares).
VOCABULARY, ADDED = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
VOCABULARY_SIZE = 50_257
#: Texts of a batch that a task encodes at a time.
TEXTS = 256


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """(string, id) of the tokens that a tokenizer's file adds. The file is large when parsed, so the driver reads it for all tasks."""
    with open(path) as file:
        return tuple((t["content"], t["id"]) for t in json.load(file)["added_tokens"])


def encoder(path: str, added_path: str):
    """A function from a text to its ids: those of the ranks in one file and, for their strings, of the tokens that the other adds."""
    return _encoder(path, added_tokens(added_path))


@lru_cache(maxsize=1)
def _encoder(path: str, added: tuple[tuple[str, int], ...]):
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(added))
    return lambda text: own.encode_to_numpy(text, allowed_special="all")


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    """A sign for each id and dimension, from a hash of the id."""
    x = np.arange(VOCABULARY_SIZE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    bits = (x[:, None] >> np.arange(DIMENSIONS, dtype=np.uint64)) & np.uint64(1)
    return bits.astype(np.float32) * 2 - 1


def hilbert_keys(points: np.ndarray, bits: int = GRID_BITS) -> np.ndarray:
    """Positions on the Hilbert curve of grid points (rows of coordinates below 2 ** bits)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess rotations and reflections, from the coarsest bit
        p = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            t = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _tokenise(path: str, added: tuple[tuple[str, int], ...]):
    def run(batches):
        encode, signs = _encoder(path, added), _signs()
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            ids, sums = [], np.zeros((batch.num_rows, DIMENSIONS))
            for row, text in enumerate(batch.column(1).to_pylist()):
                own = encode(text)
                sums[row] = signs[own].sum(axis=0)
                ids.append(np.append(own, END).astype("<u2").tobytes())
            length = np.maximum(1e-9, np.sqrt((sums**2).sum(axis=1, keepdims=True)))
            grid = np.clip((sums / length + 1) / 2 * (1 << GRID_BITS), 0, (1 << GRID_BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hilbert_keys(grid)), pa.array(ids, pa.binary())], ["doc_id", "key", "ids"])

    return run


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: A tail's pieces carry their ids, for the second pass; place orders them along the curve.
_TAIL = "place long, ids binary"


class _Packer:
    """Pieces (doc_id, ids, start, length, document's length) in full sequences, numbered from `first`; what is left over is in `held`."""

    def __init__(self, size: int, first: int):
        self.size, self.sequence, self.held, self.fill, self.out = size, first, [], 0, []

    def add(self, doc_id, ids: np.ndarray, start: int, of: int) -> None:
        """The ids, which begin at `start` of a document of `of` ids."""
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, self.size - self.fill)
            self.held.append((doc_id, ids[at : at + n], start + at, of))
            at, self.fill = at + n, self.fill + n
            if self.fill == self.size:
                self._close(self.held)
                self.held, self.fill = [], 0

    def finish(self) -> None:
        """Packs the rest into sequences of powers of two."""
        for bit in range(self.fill.bit_length() - 1, -1, -1):
            room, pieces = self.fill & (1 << bit), []
            while room:
                doc_id, ids, start, of = self.held.pop(0)
                pieces.append((doc_id, ids[:room], start, of))
                if len(ids) > room:
                    self.held.insert(0, (doc_id, ids[room:], start + room, of))
                room -= min(len(ids), room)
            if pieces:
                self._close(pieces)

    def _close(self, pieces) -> None:
        offset = 0
        for doc_id, ids, start, of in pieces:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), of, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def flushed(self, tails=()) -> pa.RecordBatch:
        """The pieces that are packed, and tails: those that are not."""
        rows = [(*r, None, None) for r in self.out] + list(tails)
        columns = list(zip(*rows, strict=True)) or [[]] * 9
        self.out = []
        kinds = [*[pa.int64()] * 8, pa.binary()]
        names = [f.split()[0] for f in f"{_PIECE}, {_TAIL}".split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _pack(size: int):
    """Full sequences of a range of documents; its tail, less than a sequence, is handed on."""

    def run(batches):
        range_ = TaskContext.get().partitionId()
        packer = _Packer(size, range_ << 40)
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(data.as_buffer(), "<u2")
                packer.add(doc_id, ids, 0, len(ids))
                if len(packer.out) > 50_000:
                    yield packer.flushed()
        yield packer.flushed((d, start, len(ids), None, of, None, None, (range_ << 20) + k, ids.tobytes()) for k, (d, ids, start, of) in enumerate(packer.held))

    return run


def _pack_tails(size: int):
    def run(batches):
        packer = _Packer(size, (1 << 62) | (TaskContext.get().partitionId() << 40))
        for batch in batches:
            for doc_id, start, of, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                packer.add(doc_id, np.frombuffer(data, "<u2"), start, of)
        packer.finish()
        yield packer.flushed()

    return run


def pack_documents(docs: DataFrame, size: int = SEQUENCE, vocabulary: str = VOCABULARY, added: str = ADDED) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and the end id; null counts as empty and has the
    end id alone. The strings of tokens that the vocabulary adds have those tokens'
    ids, as its tokenizer gives them. Documents are cut freely; every id lies in
    exactly one piece. Sequences have `size` tokens, but for a last few, of powers
    of two: each range of the curve hands on the tail that fills no sequence, and
    the tails are packed in order of the curve, a thousand ranges in one task. Equal
    texts have one key; a tie-break by row deals them to as many ranges as they
    need; it is stored with the ids before they are dealt, so no later task can
    number rows anew. doc_id is a number. Repeated rows are packed each, null ids
    stay null. Empty tables give no rows. Other columns are ignored, so their names
    cannot clash.
    """
    path, added_ids = public_tokenizers.path(vocabulary), added_tokens(public_tokenizers.path(added))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tokens = rows.mapInArrow(_tokenise(path, added_ids), "doc_id long, key long, ids binary")
    tokens = materialise(tokens.withColumn("tie", F.monotonically_increasing_id()), "tokens")
    tasks = tasks_for(tokens, TASK_BYTES)
    ranged = tokens.repartitionByRange(tasks, "key", "tie").sortWithinPartitions("key", "tie")
    packed = materialise(ranged.select("doc_id", "ids").mapInArrow(_pack(size), f"{_PIECE}, {_TAIL}"), "packed")
    tails = packed.filter("ids IS NOT NULL").repartitionByRange(max(1, tasks // RANGES_PER_TAIL_TASK), "place").sortWithinPartitions("place")
    last = tails.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(_pack_tails(size), f"{_PIECE}, {_TAIL}")
    return packed.filter("ids IS NULL").unionByName(last).drop("place", "ids")


QUERY = "op9_packing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


#: Tokenizing is not SQL; tests compare with the tokenizer itself and count every id.
ORACLE_SQL = None
