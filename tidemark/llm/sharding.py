"""Sharding by a hierarchical weighted hash tree.

A document descends from the root through region and rack to a shard. At each
node it draws -ln(u) / weight for each child, u being a hash of its id and the
child's path, and goes to the least draw. A child's draw does not depend on its
siblings, so if a subtree's weight grows, documents move into that subtree alone,
and if it shrinks, out of it alone. A node's weight is the sum of its shards'.

A shard that is added beyond the planned layout opens a region and rack of its
own, so every other subtree keeps its weight and the new shard takes documents
only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, sized, table, tasks_for

#: Shards of the planned layout, as regions of racks of shards.
PLANNED, REGIONS, RACKS = 24, 3, 2
#: Hexadecimal digits of a draw: 52 bits, which a double holds exactly.
DIGITS = 13

#: Bytes of rows meant for a task that numbers slots.
TASK_BYTES = 32 << 20

Tree = list[list[list[tuple[int, float]]]]


def layout(shards: int, planned: int = PLANNED, regions: int = REGIONS, racks: int = RACKS, weights: dict[int, float] | None = None) -> Tree:
    """Regions of racks of (shard, weight). The planned shards are dealt evenly; each later one has a region.

    weights: those of shards that have another than 1. A shard of weight 0 is
    drained: it keeps its place and draws nothing. A weight below 0 or that isn't
    finite raises, and so does a tree in which no shard has weight.
    """
    weights = weights or {}
    if not all(0 <= w < float("inf") for w in weights.values()):
        raise ValueError("weights must be finite and not below 0")
    if not any(weights.get(s, 1.0) > 0 for s in range(shards)):
        raise ValueError("no shard has weight")
    base = min(shards, planned)
    rows = [[[] for _ in range(racks)] for _ in range(regions)]
    per = max(1, -(-planned // (regions * racks)))
    for s in range(base):
        slot = s // per
        rows[slot // racks % regions][slot % racks].append((s, float(weights.get(s, 1.0))))
    tree = [[rack for rack in region if rack] for region in rows]
    tree = [region for region in tree if region]
    return tree + [[[(s, float(weights.get(s, 1.0)))]] for s in range(base, shards)]


def _levels(tree: Tree) -> list[list[tuple[str, str, float]]]:
    """For regions, racks and shards: (parent's path, path, weight) of each node that has weight, so that no other is drawn."""
    total = lambda racks: sum(w for rack in racks for _, w in rack)
    regions = [("", f"{r}", total(racks)) for r, racks in enumerate(tree)]
    racks = [(f"{r}", f"{r}/{k}", total([rack])) for r, all_racks in enumerate(tree) for k, rack in enumerate(all_racks)]
    shards = [(f"{r}/{k}", f"{r}/{k}/{s}", w) for r, all_racks in enumerate(tree) for k, rack in enumerate(all_racks) for s, w in rack]
    return [[node for node in level if node[2] > 0] for level in (regions, racks, shards)]


def _draw(key: Column, path: Column, weight: Column) -> Column:
    digest = F.md5(F.concat(path, F.lit("|"), key))
    u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    return -F.log(u) / weight


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard that a key (a string column) descends to in the tree."""
    at = F.lit("")
    for level in _levels(tree):
        nodes = F.array(*[F.struct(F.lit(p).alias("parent"), F.lit(path).alias("path"), F.lit(w).alias("weight")) for p, path, w in level])
        at = _bound(at, lambda parent: _least_child(key, parent, nodes))  # noqa: B023
    return F.element_at(F.split(at, "/"), -1).cast("int")


def _least_child(key: Column, parent: Column, nodes: Column) -> Column:
    own = F.filter(nodes, lambda n: n["parent"] == parent)
    return F.array_min(F.transform(own, lambda n: F.struct(_draw(key, n["path"], n["weight"]).alias("draw"), n["path"].alias("path"))))["path"]


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def shard_documents(docs: DataFrame, shards: int = PLANNED, id_column: str = "doc_id", text_column: str = "text", planned: int = PLANNED) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The id and the number of shards decide (law `key`); a null id draws as the
    empty string. size is the text's UTF-8 bytes plus 8; a null text has none.
    slot numbers the rows of a shard from 0 without gaps, in order of id, nulls
    first; rows that repeat an id get slots next to each other, in the order of a
    tie-break that is stored with them. grown_shard is the
    shard if there is one more. Empty tables give no rows. Other columns are
    ignored, so their names cannot clash.
    """
    body = F.coalesce(F.col(text_column), F.lit(""))
    dealt = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("key"),
        F.monotonically_increasing_id().alias("tie"),
    )
    dealt = dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        shard_of(F.col("key"), layout(shards, planned)).alias("shard"),
        shard_of(F.col("key"), layout(shards + 1, planned)).alias("grown_shard"),
        "tie",
    )
    # Slots without a task for a whole shard: range-sorted parts, counted, then numbered each by itself.
    dealt = materialise(dealt, "dealt")
    parts = materialise(dealt.repartitionByRange(tasks_for(dealt, TASK_BYTES), "shard", "doc_id", "tie").withColumn("part", F.spark_partition_id()), "parts")
    counts = parts.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialise(counts.withColumn("before", before), "offsets")
    numbered = parts.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "tie")) - 1)
    joined = numbered.join(sized(offsets.select("shard", "part", "before"), offsets), ["shard", "part"])
    return joined.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("before") + F.col("nth")).cast("long").alias("slot"),
        "grown_shard",
    )


QUERY = "op4_sharding"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


#: DuckDB has no CRC-32; tests compare with zlib and a plain descent of the tree.
ORACLE_SQL = None
