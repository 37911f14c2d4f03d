"""Removal of long repeated byte strings by maximal repeats of an enhanced suffix array.

No task can hold the corpus's suffix array, so it is built in parts that lose
nothing: every window of 100 bytes has an anchor (see repeats), and all windows
that are equal meet under their anchor's hash. Contexts of an anchor that are
identical are one string with many occurrences, of which all but the first are
removed. Different contexts of one anchor are sorted as suffixes; the interval tree
of their common prefixes gives the maximal repeats with all occurrences, of each of
which all but the first go. The union of these spans is exactly the bytes under
windows that also start earlier.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import lookup, materialise, scope, sized, table

#: What a row of the anchors' table is: an anchor, a span to remove, an anchor whose context is asked for.
ANCHOR, SPAN, ASKED = 0, 1, 2
_ROW = "kind int, h long, x long, doc_id long, hash long, a long, b long"
#: Anchors that are dealt, and contexts that are sorted, at a time.
BATCH_ANCHORS, BATCH_CONTEXTS = 500_000, 20_000
#: Occurrences of repeats that are held before they widen their contexts' spans.
BATCH_MEMBERS = 200_000
#: Anchors meant for a task.
TASK_ANCHORS = 2_000_000
#: Different contexts of one anchor up to which they are sorted in one task; beyond, they are split by what is around the anchor.
HOT_CONTEXTS = 50_000
_NULL_ID = -(2**63)


def _table(columns: list[np.ndarray]) -> pa.RecordBatch:
    kinds = [pa.int32()] + [pa.int64()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _ROW.split(", ")])


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A numpy view of the texts' bytes, and where each begins and the last ends in it."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = texts.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8), offsets


def _bytes_of(batch: pa.RecordBatch, column: int):
    """A numpy view of each text's bytes."""
    data, offsets = _buffer(batch.column(column))
    return [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _anchors(batches):
    """Anchors of the texts. Of anchors with one context within a batch the first goes on, the others are spans."""
    held, n = [], 0
    for batch in batches:
        ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, offsets = _buffer(batch.column(2))
        for text, pos, h, x in repeats.anchor_pieces(data, offsets):
            held.append((pos, h, x, ids[text], hashes[text], offsets[text + 1] - offsets[text]))
            n += len(pos)
            if n >= BATCH_ANCHORS:
                yield from _dealt(held)
                held, n = [], 0
    if n:
        yield from _dealt(held)


def _runs(rows: np.ndarray) -> np.ndarray:
    """Spans (document, text, start, stop as rows of an array) in order, of which those that touch are merged."""
    doc, text_hash, a, b = rows
    if not len(doc):
        return rows
    new = np.r_[True, (doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1])]
    reach = np.maximum.accumulate((np.cumsum(new) << 32) + b)  # a text is below 2 GB
    reach &= (1 << 32) - 1
    start = np.flatnonzero(new | np.r_[True, a[1:] > reach[:-1]])
    return np.stack([doc[start], text_hash[start], a[start], reach[np.r_[start[1:], len(doc)] - 1]])


def _elsewhere(first: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Whether each row's place (document, text, position) is another than that of the row `first` names for it."""
    return np.logical_or.reduce([x != x[first] for x in place])


def _dealt(held: list):
    pos, h, x, doc, text_hash, length = (np.concatenate([t[k] for t in held]) for k in range(6))
    # contexts are equal if both hashes are; only those that recur need an order
    order = np.argsort(x)
    alike = x[order][1:] == x[order][:-1]
    recurs = np.r_[alike, False] | np.r_[False, alike]
    once, several = order[~recurs], order[recurs]
    several = several[np.lexsort((pos[several], text_hash[several], doc[several], h[several], x[several]))]
    new = np.r_[True, (h[several][1:] != h[several][:-1]) | (x[several][1:] != x[several][:-1])] if len(several) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(several)), 0))
    later = several[~new & _elsewhere(first, doc[several], text_hash[several], pos[several])]
    go = np.sort(np.r_[once, several[new]])  # by text, which shuffles in fewer bytes
    begin, end = pos - np.minimum(pos, repeats.BEFORE), pos + np.minimum(length - pos, repeats.WINDOW)
    for i in range(0, len(go), 200_000):  # a: position, b: bytes before and from it on
        r = go[i : i + 200_000]
        left, right = pos[r] - begin[r], end[r] - pos[r]
        yield _table([np.full(len(r), ANCHOR), h[r].view(np.int64), x[r].view(np.int64), doc[r], text_hash[r], pos[r], left * 256 + right])
    later.sort()  # by text, mostly in order then
    later = later[np.lexsort((begin[later], text_hash[later], doc[later]))]
    spans = _runs(np.stack([doc[later], text_hash[later], begin[later], end[later]]))
    for i in range(0, spans.shape[1], 200_000):
        owner, text, a, b = spans[:, i : i + 200_000]
        # a span is dealt by a hash of its own, so a hot anchor's spans don't meet
        yield _table([np.full(len(a), SPAN), owner * 31 + a * 7, np.zeros(len(a), np.int64), owner, text, a, b])


def _classes(batches):
    """Sorted anchors in; spans of all but the first of each context, and the first ones of anchors with several contexts."""
    carried = None  # (h, x, doc_id, a) of the context that is open
    waiting = None  # its first row, until the next context shows whether it is alone
    for batch in batches:
        kind, h, x, doc, text_hash, a, b = (batch.column(k).to_numpy() for k in range(7))
        spans = np.flatnonzero(kind == SPAN)
        if len(spans):
            yield _table([kind[spans], h[spans], x[spans], doc[spans], text_hash[spans], a[spans], b[spans]])
        own = np.flatnonzero(kind == ANCHOR)
        if not len(own):
            continue
        rows = np.stack([h[own], x[own], doc[own], text_hash[own], a[own], b[own]])
        if waiting is not None:
            rows = np.concatenate([waiting[:, None], rows], axis=1)
        h, x, doc, text_hash, a, b = rows
        new = np.r_[True, (h[1:] != h[:-1]) | (x[1:] != x[:-1])]
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        later = np.flatnonzero(~new & _elsewhere(first, doc, text_hash, a))
        left, right = b[later] // 256, b[later] % 256
        yield _table([np.full(len(later), SPAN), h[later], x[later], doc[later], text_hash[later], a[later] - left, a[later] + right])
        lead = np.flatnonzero(new)
        alike_next = np.r_[h[lead][1:] == h[lead][:-1], False]
        alike_before = np.r_[carried is not None and carried == h[lead][0], alike_next[:-1]]
        # the last context stays open: a later batch may hold more of it, or another context of its anchor
        asked = lead[:-1][(alike_next | alike_before)[:-1]]
        yield _table([np.full(len(asked), ASKED), h[asked], x[asked], doc[asked], text_hash[asked], a[asked], b[asked]])
        if len(lead) > 1:
            carried = h[lead[-2]]
        waiting = rows[:, lead[-1]]
    if waiting is not None and carried is not None and carried == waiting[0]:
        h, x, doc, text_hash, a, b = (np.array([v]) for v in waiting)
        yield _table([np.array([ASKED]), h, x, doc, text_hash, a, b])


_CONTEXT = "h long, doc_id long, hash long, a long, b long, context binary"


def _contexts(batches):
    """The bytes around each position that a document is asked for."""
    for batch in batches:
        data, offsets = _buffer(batch.column(2))
        asked = batch.column(3)
        owner = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy())
        h, a, b = (x.to_numpy() for x in asked.flatten().flatten())
        ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i in range(0, len(h), BATCH_CONTEXTS):
            own, at, sides = owner[i : i + BATCH_CONTEXTS], a[i : i + BATCH_CONTEXTS], b[i : i + BATCH_CONTEXTS]
            left, right = sides // 256, sides % 256
            ends = np.r_[0, np.cumsum(left + right)]
            place = np.arange(ends[-1]) + np.repeat(offsets[own] + at - left - ends[:-1], left + right)
            context = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[place])])
            columns = [*(pa.array(v, pa.int64()) for v in (h[i : i + BATCH_CONTEXTS], ids[own], hashes[own], at, sides)), context]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _CONTEXT.split(", ")])


def _repeat_spans(batches):
    """Spans to remove by the maximal repeats among contexts sorted by anchor."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < BATCH_CONTEXTS:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        h = whole.column(0).to_numpy()
        cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
        if cut:
            yield from _spans_of(whole.slice(0, cut))
            held, rows = whole.slice(cut).to_batches(), whole.num_rows - cut
    if rows:
        yield from _spans_of(pa.Table.from_batches(held).combine_chunks())


def _matrix(contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts' bytes with their anchors in one column, and the bytes before and from the anchors on."""
    b = contexts.column(4).to_numpy()
    left, right = b // 256, b % 256
    data = contexts.column(5)
    data = data.combine_chunks() if isinstance(data, pa.ChunkedArray) else data
    data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
    offsets = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, data.offset * 4).astype(np.int64)
    raw = np.frombuffer(data.buffers()[2], np.uint8)
    column = np.arange(repeats.CONTEXT)
    at = offsets[:-1, None] + column - (repeats.BEFORE - left)[:, None]
    inside = (column >= (repeats.BEFORE - left)[:, None]) & (column < (repeats.BEFORE + right)[:, None])
    return np.where(inside, raw[np.clip(at, 0, len(raw) - 1)], 0).astype(np.uint8), left, right


def _spans_of(contexts: pa.Table):
    """One span for each context that has bytes to remove: all spans around an anchor hold it, so their union has no gap."""
    h, doc, text_hash, a = (contexts.column(k).to_numpy() for k in range(4))
    context, left, right = _matrix(contexts)
    order = np.lexsort((a, text_hash, doc))
    ranks = np.r_[0, np.cumsum(np.logical_or.reduce([v[order][1:] != v[order][:-1] for v in (doc, text_hash, a)]))]
    place = np.empty(len(a), np.int64)
    place[order] = ranks
    before, after = np.full(len(a), -1, np.int64), np.zeros(len(a), np.int64)
    held, members = [], 0

    def reach():
        size = np.array([len(rows) for _, rows, _ in held])
        rows = np.concatenate([rows for _, rows, _ in held])
        l, length = (np.repeat([t[k] for t in held], size) for k in (0, 2))  # noqa: E741
        first = np.minimum.reduceat(place[rows], np.r_[0, np.cumsum(size)[:-1]])
        later = place[rows] != np.repeat(first, size)
        np.maximum.at(before, rows[later], l[later])
        np.maximum.at(after, rows[later], (length - l)[later])

    for found in repeats.maximal_repeats(h, context, left, right):
        held.append(found)
        members += len(found[1])
        if members >= BATCH_MEMBERS:
            reach()
            held, members = [], 0
    if held:
        reach()
    r = np.flatnonzero(before >= 0)
    if len(r):
        yield _table([np.full(len(r), SPAN), h[r], np.zeros(len(r), np.int64), doc[r], text_hash[r], a[r] - before[r], a[r] + after[r]])


_PART = f"{_CONTEXT}, region int"


def _split(batches):
    """Contexts of an anchor that share a region around it, dealt to two groups that share more of it.

    region is 256 times the bytes before the anchor and the bytes from it on that a
    group shares. A window that holds the region has at least half of its other
    bytes on one side, so equal windows meet in the group of that side.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_CONTEXTS):
            part = batch.slice(at, BATCH_CONTEXTS)
            h, region = part.column(0).to_numpy().view(np.uint64), part.column(6).to_numpy().astype(np.int64)
            context, left, right = _matrix(part)
            more = -(-(repeats.WINDOW - region // 256 - region % 256) // 2)
            for l, r in ((region // 256 + more, region % 256), (region // 256, region % 256 + more)):  # noqa: E741
                rows = np.flatnonzero((l <= left) & (r <= right))
                column = np.arange(repeats.CONTEXT)
                inside = (column >= repeats.BEFORE - l[rows, None]) & (column < repeats.BEFORE + r[rows, None])
                key = repeats.row_hashes(np.where(inside, context[rows], 0), h[rows] ^ (l[rows] * 256 + r[rows]).astype(np.uint64))
                some = part.take(pa.array(rows))
                columns = [pa.array(key.view(np.int64)), *some.columns[1:6], pa.array((l[rows] * 256 + r[rows]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _PART.split(", ")])


def _hot_spans(contexts: DataFrame, tasks: int) -> DataFrame:
    """Spans of the contexts of anchors that have too many for one task.

    Groups are split by more and more of the bytes around their anchor until one
    task can sort them; a group that shares a whole window is one interval of the
    tree, of which all but the first occurrence go.
    """
    level = contexts.withColumn("region", F.lit(repeats.GRAM))
    whole = F.floor(F.col("region") / 256) + F.col("region") % 256 == repeats.WINDOW
    made = []
    while level.head(1):
        level = materialise(level.repartition(tasks).mapInArrow(_split, _PART), "split")
        counts = materialise(level.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "hash", "a")).alias("first")).filter("n > 1"), "counts")
        told = lookup(level, counts, ["h"]).filter("n > 1")
        usual = told.filter((F.col("n") <= HOT_CONTEXTS) & ~whole).select(*[x.split()[0] for x in _CONTEXT.split(", ")])
        made.append(usual.repartition(tasks, "h").sortWithinPartitions("h").mapInArrow(_repeat_spans, _ROW))
        first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash")) & (F.col("a") == F.col("first.a"))
        begin = F.col("a") - F.floor(F.col("region") / 256)
        later = told.filter(whole & ~first).select(F.lit(SPAN).alias("kind"), "h", F.lit(0).cast("long").alias("x"), "doc_id", "hash", begin.alias("a"), (begin + repeats.WINDOW).alias("b"))
        made.append(later)
        level = materialise(told.filter((F.col("n") > HOT_CONTEXTS) & ~whole).select(level.columns), "level")
    return reduce(DataFrame.unionByName, made)


_MERGED = "doc_id long, hash long, starts array<long>, stops array<long>, n long"


def _merged(batches):
    """Spans sorted by document and start, merged to one row for each document."""
    closed: list[np.ndarray] = []  # merged spans of the document that is open
    last = np.zeros((4, 0), np.int64)  # its last one, which may go on
    for batch in batches:
        runs = _runs(np.concatenate([last, np.stack([batch.column(k).to_numpy() for k in range(4)])], axis=1))
        closed.append(runs[:, :-1])
        last = runs[:, -1:]
        if (runs[:2, :1] == last[:2]).all():
            continue
        done = np.concatenate(closed, axis=1)
        whole = int(np.argmax(np.r_[(done[:2] == last[:2]).all(axis=0), True]))
        yield _documents(done[:, :whole])
        closed = [done[:, whole:]]
    if last.shape[1]:
        yield _documents(np.concatenate([*closed, last], axis=1))


def _documents(runs: np.ndarray) -> pa.RecordBatch:
    """One row for each document of merged spans."""
    doc, text_hash, a, b = runs
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1])])
    edges = pa.array(np.r_[first, len(doc)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(edges, pa.array(v)) for v in (a, b)]
    columns = [pa.array(doc[first]), pa.array(text_hash[first]), *lists, pa.array(np.diff(np.r_[first, len(doc)]))]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _MERGED.split(", ")])


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _cut(with_text: bool):
    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for k, data in enumerate(_bytes_of(batch, 1)):
                starts, stops = batch.column(2)[k].as_py() or [], batch.column(3)[k].as_py() or []
                raw = data.tobytes()
                kept = b"".join(raw[a:b] for a, b in zip([0, *stops], [*starts, len(raw)], strict=True))
                row = (len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            arrays = [pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [x.split()[0] for x in _KEPT.split(", ")])

    return run


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, starts, stops, n) of documents with bytes to remove; docs has doc_id, hash, text."""
    conf = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(conf, math.ceil(size / 30 / TASK_ANCHORS))  # an anchor in some 30 bytes
    dealt = docs.mapInArrow(_anchors, _ROW).repartition(parts, "h").sortWithinPartitions("h", "x", "doc_id", "hash", "a")
    found = materialise(dealt.mapInArrow(_classes, _ROW), "classes")
    asked = found.filter(F.col("kind") == ASKED).select("doc_id", "hash", "h", "a", "b")
    hot = materialise(asked.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_CONTEXTS).select("h"), "hot")
    n_hot = hot.count()

    def contexts(rows: DataFrame) -> DataFrame:
        # the list grows with the texts, so it is never broadcast: one plan at every size
        wanted = rows.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("h", "a", "b")).alias("asked"))
        own = docs.join(wanted.hint("merge"), ["doc_id", "hash"]).select("doc_id", "hash", "text", "asked")
        return own.mapInArrow(_contexts, _CONTEXT)

    usual = asked.join(sized(hot), "h", "left_anti") if n_hot else asked
    sorted_contexts = contexts(usual).repartition(parts, "h").sortWithinPartitions("h")
    spans = found.filter(F.col("kind") == SPAN).unionByName(sorted_contexts.mapInArrow(_repeat_spans, _ROW))
    if n_hot:
        spans = spans.unionByName(_hot_spans(contexts(asked.join(sized(hot), "h", "left_semi")), parts))
    own = spans.select("doc_id", "hash", "a", "b").repartition(parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "a")
    return own.mapInArrow(_merged, _MERGED)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    Each byte goes that is covered by a string of 100 bytes that also starts
    earlier: in a document of smaller id (null ids first), or in the same at a
    lower position. Null texts count as empty; texts below 100 bytes stay whole.
    Rows that repeat id and text count as one document and get the same result.
    kept_text is null unless asked for; characters that a cut splits are left out
    of it. Empty tables give no rows. Other columns are ignored, so their names
    cannot clash.
    """
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    with scope(docs.sparkSession) as own:
        merged = own.keep(materialise(repeated_spans(rows), "merged"))
    joined = rows.join(merged.hint("merge"), ["doc_id", "hash"], "left")
    made = joined.select("doc_id", "text", "starts", "stops").mapInArrow(_cut(with_text), _KEPT)
    return made.withColumn("doc_id", F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")))


QUERY = "op10_suffix_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


#: All windows of all texts are beyond SQL; tests compare with brute force.
ORACLE_SQL = None
