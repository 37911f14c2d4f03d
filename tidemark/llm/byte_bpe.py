"""Byte-level BPE encoding and decoding by a rank queue over a hierarchical bitmap.

A text is cut into pre-tokens, each of which is merged by itself. A pre-token's
bytes are a linked list of tokens. Every pair that the vocabulary knows waits in
the bucket of its merge rank, under its left token's position. A bitmap says which
buckets are in use, and a second one which of its leaves are, so the least rank is
found by two find-first-sets, however many pairs wait. Entries whose pair has
changed are skipped when they come up. A pre-token of n bytes takes O(n log n)
steps.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens whose ids a task remembers: those of so many characters at most, and so many of a space and letters, a quarter of it of others.
REMEMBERED_CHARS, REMEMBERED = 48, 5 << 17
#: Rows that a task encodes or decodes at a time.
ROWS = 256
#: Ranks of a leaf of the bitmap.
LEAF_BITS = 8
LEAF_MASK = (1 << LEAF_BITS) - 1
BIT = [1 << k for k in range(1 << LEAF_BITS)]
#: Runs of the pattern's white space (Unicode's, named in full) but for single spaces before a word; a space at the text's start or end is a run, too.
_RUNS = re.compile(r"[{0} ]{{2,}}|[{0}]|^ | \Z".format("\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000")).finditer


class _Known(dict):
    """Ids, as bytes of 32-bit numbers, of strings that have been encoded.

    Short strings are remembered. When there are as many as REMEMBERED allows, they become the
    older generation, those of the one before go, and what is asked for again comes
    back, so memory is bounded and frequent strings stay.
    """

    def __init__(self, encode, share: int = 4):
        super().__init__()
        self._encode, self._older, self._share = encode, {}, share

    def __missing__(self, text: str) -> bytes:
        found = self._older.get(text)
        if found is None:
            found = self._encode(text)
        if len(text) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED // self._share:
                self._older.clear()
                self._older.update(self)
                self.clear()
            self[text] = found
        return found


class ByteBpe:
    """Encodes and decodes by the ranks of a vocabulary, which must hold all single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self._token = np.full(max(ranks.values(), default=0) + 1, None, object)
        for token, rank in ranks.items():
            self._token[rank] = token
        self._split = regex.compile(pattern).findall
        self._by_word = pattern == public_tokenizers.PATTERN
        self._leaves = [0] * ((len(self._token) >> LEAF_BITS) + 1)
        self._buckets: dict[int, int | list[int]] = {}
        self._pairs = [[ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]
        self._pieces = _Known(self._merged)
        self._words = _Known(self._encoded_word)
        self._spaced = _Known(self._encoded_spaced, 1)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: the pair of least rank is merged first, of equal ones the leftmost.

        The queue's steps stand in line, as most pre-tokens are short. It is empty
        before and after. A bucket is a position, or a heap of several.
        """
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, find, leaves, buckets, pairs, top = len(piece), self.ranks.get, self._leaves, self._buckets, self._pairs, 0
        # a token is named by its first byte's place: end is the next token's name, n the text's end
        end, before = list(range(1, n + 2)), list(range(-1, n))
        pair = [pairs[a][b] for a, b in zip(piece, piece[1:], strict=False)]
        pair.append(-1)
        fresh = range(n - 1)
        while True:
            for i in fresh:  # pairs that have come about since
                rank = pair[i]
                if rank < 0:
                    continue
                if rank not in buckets:
                    buckets[rank] = i
                    at = rank >> LEAF_BITS
                    leaves[at] |= BIT[rank & LEAF_MASK]
                    top |= 1 << at
                elif (bucket := buckets[rank]).__class__ is int:
                    buckets[rank] = [bucket, i] if bucket < i else [i, bucket]
                else:
                    heappush(bucket, i)
            while top:
                high = top & -top
                at = high.bit_length() - 1
                leaf = leaves[at]
                low = leaf & -leaf
                rank = (at << LEAF_BITS) + low.bit_length() - 1
                i = buckets[rank]
                if i.__class__ is int:
                    del buckets[rank]
                    leaves[at] = leaf ^ low
                    if leaf == low:
                        top ^= high
                else:
                    bucket = i
                    i = heappop(bucket)
                    if len(bucket) == 1:
                        buckets[rank] = bucket[0]
                if pair[i] == rank:
                    break  # else stale: one of the pair's tokens has been merged since
            else:
                break
            gone = end[i]
            pair[gone] = -1
            last = end[i] = end[gone]
            before[last] = i
            pair[i] = find(piece[i : end[last]], -1) if last < n else -1
            left = before[i]
            if left < 0:
                fresh = (i,)
            else:
                pair[left] = find(piece[left:last], -1)
                fresh = (left, i)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def _encoded_word(self, word: str) -> bytes:
        return self._merged(word) if word.isalpha() else self._joined(self._split(word))

    def _encoded_spaced(self, word: str) -> bytes:
        # a space and letters alone are one pre-token
        return self._merged(" " + word) if word.isalpha() else self._joined(self._split(" " + word))

    def _merged(self, piece: str) -> bytes:
        return array("i", self.merge(piece.encode())).tobytes()

    def _joined(self, pieces: list[str]) -> bytes:
        """The ids of several pre-tokens; those of a space and letters are remembered by the letters."""
        return b"".join([self._spaced[p[1:]] if p[0] == " " and p[1:].isalpha() else self._pieces[p] for p in pieces])

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, without special tokens: their strings are ordinary text."""
        return np.frombuffer(self._encoded_words(text) if self._by_word else self._joined(self._split(text)), np.int32)

    def _encoded_words(self, text: str) -> bytes:
        """The ids by words, which are cut at white space as the pattern cuts.

        A pre-token never goes on across white space, and takes one space at its
        front at most. Of a longer run before a word the last character stands alone
        unless it is a space, which goes to the word; the run's rest is a pre-token,
        and so is a run at the text's end.
        """
        out, at, spaced = [], 0, False
        for run in _RUNS(text):
            a, b = run.span()
            self._add_words(out, text[at:a], spaced)
            at, last = b, text[b - 1]
            spaced = last == " " and b < len(text)
            if b == len(text):
                out.append(self._pieces[text[a:b]])
            else:
                out.append(self._pieces[text[a : b - 1]] if b - a > 1 else b"")
                if not spaced:
                    out.append(self._pieces[last])
        self._add_words(out, text[at:], spaced)
        return b"".join(out)

    def _add_words(self, out: list[bytes], words: str, spaced: bool) -> None:
        """Appends the ids of words between which single spaces stand; spaced: one stands before them as well."""
        if words:
            first, *others = words.split(" ")
            out.append((self._spaced if spaced else self._words)[first])
            out.extend(map(self._spaced.__getitem__, others))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for; an id that the vocabulary lacks raises."""
        return b"".join(self._token[ids].tolist())


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    """The tokenizer of a file of ranks; a worker process reads it once."""
    with open(path, "rb") as lines:
        return ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def _parts(batches):
    """The batches cut into ROWS rows, so that what a task holds beside a batch is bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))


def _id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, ids (array of int).

    A null text counts as empty and has no ids. Rows are encoded each, so repeated
    rows and null ids stay as they are. Empty tables give no rows. Other columns
    are ignored, so their names cannot clash. vocabulary: a file of ranks that
    public_tokenizers knows.
    """
    path = public_tokenizers.path(vocabulary)

    def run(batches):
        bpe = tokenizer(path)
        for part in _parts(batches):
            ids = _lists([bpe.encode(text or "") for text in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"doc_id {_id_type(rows, 'doc_id')}, ids array<int>")


def decode_documents(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each row of tokens (doc_id, ids): doc_id, ids, data (the bytes).

    Null or empty ids give no bytes. An id that the vocabulary lacks, or a null
    among the ids, fails the job. Other columns are ignored.
    """
    path = public_tokenizers.path(vocabulary)

    def run(batches):
        bpe = tokenizer(path)
        for batch in _parts(batches):
            column = batch.column(1)
            ends = np.cumsum([0, *column.value_lengths().fill_null(0).to_pylist()])
            ids = column.flatten().to_numpy(zero_copy_only=False)
            data = [bpe.decode(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(data, pa.binary())], ["doc_id", "ids", "data"])

    rows = tokens.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {_id_type(rows, 'doc_id')}, ids array<int>, data binary")


def encode_and_decode(docs: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """decode_documents(encode_documents(docs)) by one Python worker for each task, so one copy of the vocabulary."""
    path = public_tokenizers.path(vocabulary)

    def run(batches):
        bpe = tokenizer(path)
        for part in _parts(batches):
            found = [bpe.encode(text or "") for text in part.column(1).to_pylist()]
            data = pa.array([bpe.decode(ids) for ids in found], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(found), data], ["doc_id", "ids", "data"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"doc_id {_id_type(rows, 'doc_id')}, ids array<int>, data binary")


QUERY = "op11_byte_bpe"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = encode_and_decode(table(spark, sf_dir, "documents"))
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


#: Merging is not SQL; tests compare with the tiktoken library and a plain merge.
ORACLE_SQL = None
