"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints of 64 bits link if at most 3 bits differ. Half the radius is 1, which
meets at 2 differing bits, so each fingerprint is also looked at with one of four
16-bit blocks set aside: of 3 differing bits at least one is set aside in some
view. In every view a fingerprint emits the 49 variants of its other 48 bits
within one bit; rows shuffle on the variant. Two fingerprints in one bucket differ
by at most 2 of the 48 bits, so they link for certain if their blocks differ by at
most one bit; and if both are unchanged, if their blocks differ by at most three.
Every pair within 3 bits meets under one of these rules, so a bucket is linked by
looking blocks up, in time linear in its size, without forming its pairs. A bucket
holds 49 * 2^16 fingerprints at most.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, materialise, measured, sized, table, weight
from .components import components
from .text_hash import shingle_sets, simhashes

RADIUS, BLOCKS, BLOCK_BITS = 3, 4, 16
#: Variant rows that a task is meant to sort.
TASK_ROWS = 3_000_000
#: Shingles that are known to be common, which come last in prefixes; found in a sample of one text in so many.
COMMON, SAMPLED = 200_000, 16
#: Buckets up to this size give all their pairs at once, larger ones by way of a leader.
PAIRED = 32


def fingerprints(docs: DataFrame, words: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp long) for each row of docs, whole texts; null counts as empty, whose fingerprint is zero."""

    def run(batches):
        for batch in batches:
            made = simhashes(batch.column(1), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _variants(fp: Column) -> Column:
    """Array of keys: block number, then the other 48 bits with none or one of them flipped."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(64 - BLOCK_BITS)])
    views = []
    for b in range(BLOCKS):
        low = fp.bitwiseAND(F.lit((1 << (BLOCK_BITS * b)) - 1).cast("long"))
        high = F.shiftleft(F.shiftrightunsigned(fp, BLOCK_BITS * (b + 1)), BLOCK_BITS * b) if b + 1 < BLOCKS else F.lit(0).cast("long")
        views.append(low.bitwiseOR(high).bitwiseOR(F.lit(b << 48).cast("long")))
    return F.flatten(F.transform(F.array(*views), lambda v: F.transform(flips, lambda f: v.bitwiseXOR(f))))


def _chain(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as (a, b), of at most two to a node."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        for at in (x, y, label[x], label[y]):
            np.minimum.at(new, at, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    order = np.argsort(label, kind="stable")
    same = label[order][1:] == label[order][:-1]
    return nodes[order][:-1][same], nodes[order][1:][same]


def _block_links(run: np.ndarray, block: np.ndarray, fp: np.ndarray, offsets: list[int]):
    """Pairs of rows of one run whose blocks differ by one of the offsets; (run, block) pairs may repeat."""
    spot = run.astype(np.int64) << np.int64(BLOCK_BITS) | block.astype(np.int64)
    order = np.argsort(spot, kind="stable")
    spot, fp = spot[order], fp[order]
    same = spot[1:] == spot[:-1]
    yield fp[:-1][same], fp[1:][same]
    first = np.r_[True, ~same] if len(spot) else np.zeros(0, bool)
    spot, fp = spot[first], fp[first]
    for offset in offsets:
        other = spot ^ np.int64(offset)
        own = np.flatnonzero(other > spot)
        at = np.minimum(np.searchsorted(spot, other[own]), len(spot) - 1)
        hit = spot[at] == other[own]
        yield fp[own[hit]], fp[at[hit]]


_ONE = [1 << i for i in range(BLOCK_BITS)]
_TWO_OR_THREE = [sum(1 << i for i in c) for n in (2, 3) for c in combinations(range(BLOCK_BITS), n)]


def _link_buckets(batches):
    """Links between fingerprints of a partition's buckets: rows (key, fp) in, (a, b) out."""
    keys, fps = [], []
    for batch in batches:
        keys.append(batch.column(0).to_numpy().view(np.uint64))
        fps.append(batch.column(1).to_numpy().view(np.uint64))
    if not keys:
        return
    key, fp = np.concatenate(keys), np.concatenate(fps)
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    new = np.r_[True, key[1:] != key[:-1]]
    several = ~(new & np.r_[new[1:], True])
    key, fp, run = key[several], fp[several], np.cumsum(new)[several]
    if not len(key):
        return
    b = (key >> np.uint64(48)).astype(np.uint64)
    shift = b * np.uint64(BLOCK_BITS)
    block = (fp >> shift) & np.uint64((1 << BLOCK_BITS) - 1)
    low = fp & ((np.uint64(1) << shift) - np.uint64(1))
    high = np.where(b == BLOCKS - 1, np.uint64(0), (fp >> np.minimum(shift + np.uint64(BLOCK_BITS), np.uint64(63))) << shift)
    centre = (low | high) == (key & np.uint64((1 << 48) - 1))
    found = list(_block_links(run, block, fp, _ONE))
    own_run = run[centre]
    many = np.isin(own_run, own_run[1:][own_run[1:] == own_run[:-1]])
    if many.any():
        found += list(_block_links(own_run[many], block[centre][many], fp[centre][many], _TWO_OR_THREE))
    a, b2 = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
    near = np.bitwise_count(a ^ b2) <= RADIUS  # verified, bit by bit
    a, b2 = _chain(a[near], b2[near])
    for i in range(0, len(a), 100_000):
        part = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(a[part].view(np.int64)), pa.array(b2[part].view(np.int64))], ["a", "b"])


def _shuffled(rows: DataFrame, expected: int) -> DataFrame:
    """rows dealt by key to tasks of about TASK_ROWS; keys are hashes, so tasks are even."""
    conf = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(conf, math.ceil(expected / TASK_ROWS)), "key")


def fingerprint_links(distinct: DataFrame, rows: int) -> DataFrame:
    """Links (a, b) with the components of all pairs of the distinct fp within RADIUS bits."""
    emitted = distinct.select("fp", F.explode(_variants(F.col("fp"))).alias("key")).select("key", "fp")
    return _shuffled(emitted, rows * BLOCKS * (65 - BLOCK_BITS)).mapInArrow(_link_buckets, "a long, b long")


def fingerprint_components(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, fp, component_id (smallest doc_id reachable, itself included).

    Shingles have `words` words, a shorter text is one shingle, and a text without
    words (null, empty, blank) has fingerprint zero, which links like any other.
    Null ids never are the smallest; a component of null ids alone has a null
    component_id. doc_id is a number. Repeated rows share a fingerprint and so a component. Empty tables
    give no rows. Other columns are ignored, so their names cannot clash.
    """
    prints = materialise(fingerprints(docs, words), "prints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = materialise(fingerprint_links(distinct.select("fp"), weight(distinct)[0]), "pairs")
    found = components(links)
    roots = found.select(F.col("node").alias("fp"), F.col("component").alias("root"))
    joined = distinct.join(sized(roots, found), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialise(joined, "rooted")
    roots = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    classes = materialise(lookup(rooted.select("fp", "root"), roots, ["root"]).select("fp", "component_id"), "classes")
    return lookup(prints, classes, ["fp"]).select("doc_id", "fp", "component_id")


# Near-duplicate removal links by ball hashing first. Similarity of 0.8 is some ten differing bits of 64, far beyond the
# radius, and no number of fingerprints finds every such pair, so what is left is found by an exact rule: under any one order of all shingles, two sets
# of Jaccard similarity t share a shingle among the first n - ceil(t n) + 1 of each, n being the set's size.


def _starts(owner: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])


def _set_hash(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64 bits that tell sets apart: the sum of their shingles' hashes, mixed anew."""
    mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B185EBCA87)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), start)


def _set_fingerprint(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The SimHash of each set of shingles: a bit is 1 if it is set in over half of the hashes."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, start, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _lists(h: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(h.view(np.int64)))


def _sets(words: int):
    """Rows (doc_id, text) in, (node, shingles) out; node is the hash of the set."""

    def run(batches):
        for batch in batches:
            for owner, h in shingle_sets(batch.column(1), words):
                start = _starts(owner)
                size = np.diff(np.r_[start, len(h)])
                yield pa.RecordBatch.from_arrays([pa.array(_set_hash(h, start).view(np.int64)), _lists(h, size)], ["node", "shingles"])

    return run


def _prefixes(words: int, similarity: float, common, often):
    """Rows (doc_id, text) in, (doc_id, node, fp, size, prefix, plain) out; fp is the set's SimHash; common, sorted, are the shingles that come last, by how often they are seen.

    plain counts the shingles of the prefix before those that are seen in more than PAIRED sampled texts.
    """

    def run(batches):
        last, seen = common.value, often.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for owner, h in shingle_sets(batch.column(1), words):
                start = _starts(owner)
                size = np.diff(np.r_[start, len(h)])
                node, fp = _set_hash(h, start), _set_fingerprint(h, start, size)
                rank = np.zeros(len(h), np.int64)
                if len(last):
                    at = np.minimum(np.searchsorted(last, h), len(last) - 1)
                    rank = np.where(last[at] == h, seen[at], 0)
                order = np.lexsort((h, rank, owner))
                h, rank = h[order], rank[order]
                length = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
                length = np.minimum(length, size)
                inside = np.arange(len(h)) - np.repeat(start, size) < np.repeat(length, size)
                plain = np.add.reduceat((inside & (rank <= PAIRED)).astype(np.int64), start)
                columns = [pa.array(ids[owner[start]]), pa.array(node.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(size.astype(np.int64)), _lists(h[inside], length), pa.array(plain)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "fp", "size", "prefix", "plain"])

    return run


_MET = "key long, a long, size_a long, at_a long, b long, size_b long"


def _met(similarity: float):
    """Rows (key, node, size, at) in. Out, rows of _MET: pairs of buckets up to PAIRED, without key, and the members of larger ones, without b."""

    def run(batches):
        held = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if not held:
            return
        key, node, size, at = (np.concatenate([x[i] for x in held]) for i in range(4))
        order = np.lexsort((node, key))
        key, node, size, at = key[order], node[order], size[order], at[order]
        start = _starts(key)
        peers = np.diff(np.r_[start, len(key)])
        peers = np.repeat(peers, peers)
        for step in range(1, PAIRED):
            own = np.flatnonzero((key[step:] == key[:-step]) & (peers[step:] <= PAIRED))
            m, n = size[own], size[own + step]
            own = own[(node[own] != node[own + step]) & (np.minimum(m, n) >= similarity * np.maximum(m, n) - 1e-9)]
            yield from _rows(None, node[own], size[own], None, node[own + step], size[own + step])
        large = np.flatnonzero(peers > PAIRED)
        yield from _rows(key[large], node[large], size[large], at[large], None, None)

    return run


def _rows(*columns):
    n = next(len(c) for c in columns if c is not None)
    for i in range(0, n, 100_000):
        m = min(n - i, 100_000)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()) if c is None else pa.array(c[i : i + m]) for c in columns], [x.split()[0] for x in _MET.split(", ")])


def _common(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles seen most often in a sample of the texts, sorted, and how often. They order the prefixes and decide nothing."""
    some = rows.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    seen = some.mapInArrow(_sets(words), "node long, shingles array<long>").select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    top = seen.filter("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).toPandas()
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have at least that Jaccard similarity."""
    for end in ("a", "b"):
        # the sets grow with the texts, so they are never broadcast: one plan at every size
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"set_{end}")), end)
    common = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.filter(common / (F.size("set_a") + F.size("set_b") - common) >= similarity).select("a", "b")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp) by ball hashing, to be verified; their number grows with that of the nodes.

    Nodes of one fingerprint are paired with the smallest of them, and so are those
    of fingerprints that fingerprint_links links.
    """
    leads = materialise(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "distinct")
    links = materialise(fingerprint_links(leads.select("fp"), weight(leads)[0]).distinct(), "balls")
    lead = lambda end: sized(leads.select(F.col("fp").alias(end), F.col("lead").alias(f"node_{end}")), leads)
    near = links.join(lead("a"), "a").join(lead("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    same = lookup(nodes.select("node", "fp"), leads, ["fp"]).filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    return near.unionByName(same)


def set_components(nodes: DataFrame, rows: DataFrame, expected: int, words: int, similarity: float) -> DataFrame:
    """(node, component) by all pairs of nodes (doc_id, node, fp, size, prefix, plain) that are similar; rows have the texts (doc_id, text).

    Ball hashing of the SimHash fingerprints gives the first pairs, which are
    verified by the sets. It cannot reach all similar pairs, so the prefixes give
    the rest; of these, pairs within one class of the first need no comparison.
    Nodes that share a shingle of their prefixes meet in its bucket. Small buckets
    give all their pairs. A large bucket's leader, the one in most large buckets, is
    compared with all of it; where that leaves more than one component, nodes
    outside the bucket's largest component are compared with those of others. A
    pair is passed over only if it cannot be similar: by its sizes, by the shingles
    that its prefixes share (the common shingles are those, or lie behind the prefix
    that ends first), or, in a large bucket, by the places of the bucket's shingle,
    as only shingles from there on can be common if it is their first. All others
    are verified by the sets. Buckets of shingles that a sample shows to be common
    are large without being gathered.
    """
    placed = nodes.select(F.posexplode("prefix").alias("at", "key"), "node", "size", "plain")
    emitted = placed.filter("at < plain").select("key", "node", "size", F.col("at").cast("long").alias("at"))
    met = materialise(_shuffled(emitted, expected).mapInArrow(_met(similarity), _MET), "met")
    found = met.filter("b IS NULL").select("key", F.col("a").alias("node"), F.col("size_a").alias("size"), F.col("at_a").alias("at"))
    members = materialise(found.unionByName(placed.filter("at >= plain").select("key", "node", "size", F.col("at").cast("long").alias("at"))), "members")
    often = materialise(members.groupBy("node").agg(F.count(F.lit(1)).alias("large")), "often", members)
    some_large = bool(weight(often)[0])
    counted = met.filter("b IS NOT NULL").groupBy("a", "b").agg(F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"), F.count(F.lit(1)).alias("shared"))
    counted = materialise(counted, "counted")
    share = similarity / (1 + similarity)  # of the sum of two sizes, what similar sets have in common
    behind = lambda n: F.ceil(similarity * F.col(n) - 1e-9) - 1
    fits = F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-9
    first_common = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= share * (F.col("size_a") + F.col("size_b")) - 1e-6

    def may(pairs: DataFrame) -> DataFrame:
        """Of (a, b, size_a, size_b, shared), shared in small buckets, those that may be similar."""
        for end in ("a", "b"):
            pairs = pairs.join(sized(often.select(F.col("node").alias(end), F.col("large").alias(f"large_{end}")), often), end, "left")
        shared = F.col("shared") + F.least(F.coalesce("large_a", F.lit(0)), F.coalesce("large_b", F.lit(0)))
        needed = share * (F.col("size_a") + F.col("size_b")) - 1e-6
        return pairs.filter((shared > 0) & (shared + F.greatest(behind("size_a"), behind("size_b")) >= needed)).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        ends = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends", pairs)
        ids = materialise(nodes.select("doc_id", "node").join(sized(ends), "node", "left_semi").select("doc_id").distinct(), "ids", ends)
        own = rows.join(sized(ids), "doc_id", "left_semi").mapInArrow(_sets(words), "node long, shingles array<long>")
        sets = materialise(own.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
        return materialise(_similar(pairs, sets, similarity), "pairs")

    def of_large(pairs: DataFrame) -> DataFrame:
        """Those of the large buckets' pairs (a, b, size_a, size_b) that may be similar; a < b."""
        pairs = pairs.distinct().join(counted.select("a", "b", "shared"), ["a", "b"], "left")
        return may(pairs.withColumn("shared", F.coalesce("shared", F.lit(0))))

    def ordered(pairs: DataFrame) -> DataFrame:
        low = F.col("a") < F.col("b")
        either = lambda x, y: F.when(low, F.col(x)).otherwise(F.col(y))
        return pairs.select(either("a", "b").alias("a"), either("b", "a").alias("b"), either("size_a", "size_b").alias("size_a"), either("size_b", "size_a").alias("size_b"))

    close = verified(materialise(fingerprint_pairs(nodes), "close"))
    first = may(counted)
    if some_large:
        leaders = members.join(sized(often), "node").groupBy("key").agg(F.max(F.struct("large", "size", "node", "at")).alias("l"))
        leaders = materialise(leaders.select("key", F.col("l.node").alias("b"), F.col("l.size").alias("size_b"), F.col("l.at").alias("at_b")), "leaders", members)
        led = lookup(members.select("key", F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("at").alias("at_a")), leaders, ["key"])
        first = first.unionByName(of_large(ordered(led.filter((F.col("a") != F.col("b")) & fits & first_common)))).distinct()
    if weight(close)[0]:
        classes = components(close)
        for end in ("a", "b"):
            first = first.join(sized(classes.select(F.col("node").alias(end), F.col("component").alias(f"class_{end}")), classes), end, "left")
        first = first.filter(F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).select("a", "b")
    links = verified(materialise(first, "first")).unionByName(close)
    found = components(links)
    if not some_large:
        return found
    labelled = members.join(sized(found, found), "node", "left").withColumn("label", F.coalesce("component", "node"))
    labelled = materialise(labelled.select("key", "node", "size", "at", "label"), "labelled", members)
    held = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = held.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    mixed = materialise(mixed.select("key", F.col("most.label").alias("most")), "mixed", labelled)
    rest = lookup(labelled, mixed, ["key"]).filter("most IS NOT NULL")
    side = lambda e: [F.col("node").alias(e), F.col("size").alias(f"size_{e}"), F.col("at").alias(f"at_{e}"), F.col("label").alias(f"label_{e}")]
    one = rest.filter("label <> most").select("key", *side("a"))
    across = one.join(rest.select("key", "most", *side("b")), "key")
    # a pair outside the largest component is met from both its ends, of which one is enough
    across = across.filter((F.col("label_a") != F.col("label_b")) & fits & first_common & ((F.col("label_b") == F.col("most")) | (F.col("a") < F.col("b"))))
    second = materialise(of_large(ordered(across)), "second")
    more = verified(second) if weight(second)[0] else second
    return components(links.unionByName(more)) if weight(more)[0] else found


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of documents that are near duplicates of others.

    Documents link if their sets of shingles of so many words are that similar,
    every such pair and no other; component_id is the smallest doc_id reachable. Rows
    with a null id are left out, and so are rows without words, which are alike in
    nothing. Repeated rows are one document. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.filter(F.col("doc_id").isNotNull() & text.rlike(r"[^\x20\x09-\x0D]")).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    common, often = map(rows.sparkSession.sparkContext.broadcast, _common(rows, words))
    made = materialise(rows.mapInArrow(_prefixes(words, similarity, common, often), "doc_id long, node long, fp long, size long, prefix array<long>, plain long"), "prefixes", entries=F.sum(F.size("prefix")))
    # equal sets are one node, so copies are never compared with each other
    nodes = materialise(made.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "nodes")
    expected = measured(made, "entries") or 0
    chosen = made.join(sized(nodes.select("node", F.col("least").alias("doc_id")), nodes), ["node", "doc_id"], "left_semi")
    found = set_components(chosen, rows, expected, words, similarity)
    rooted = nodes.join(sized(found), "node", "left").withColumn("root", F.coalesce("component", "node"))
    rooted = materialise(rooted.select("node", "least", "root", (F.col("component").isNotNull() | (F.col("least") < F.col("most"))).alias("linked")), "rooted")
    roots = rooted.filter("linked").groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialise(rooted.filter("linked").join(roots, "root").select("node", "component_id"), "classes", rooted)
    joined = lookup(made.select("doc_id", "node"), classes, ["node"])
    return joined.filter(F.col("component_id").isNotNull()).select("doc_id", "component_id").distinct()


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group the one of the smallest doc_id.

    Rows with a null id and rows without words stay, rows that repeat an id stay
    or go together, and empty tables stay empty.
    """
    found = near_duplicates(docs, words, similarity)
    dropped = materialise(found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_id")), "dropped")
    right = sized(dropped)
    return docs.join(right, docs["doc_id"] == right["_id"], "left_anti")


QUERY = "op6_simhash"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: DuckDB has no XXH64; tests compare with brute force over all pairs.
ORACLE_SQL = None
