"""Secret scans by a trigram inverted index, with DataFrame functions alone.

Each rule's regular expression gives a Boolean query over trigrams that its match
must hold. Documents are indexed by the trigrams of these queries: a posting is a
(trigram, document) row. Intersecting the postings of a query's alternatives gives
a rule's candidates, which are then matched in full; a rule without mandatory
trigrams scans all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import broadcast_limit
from .common import materialise, sized, table, weight
from .trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """Leftmost matches that don't overlap; kept if the group has at least so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The first three are the base; the others are added by this scan. All are listed in the order of ties.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("bearer", r"(?i)bearer\x20+([A-Za-z0-9._~+/=-]+)", 1, 20),
)
RULES = BASE + ADDED
#: Pieces whose places are summed one by one; beyond, by the sums of so many.
BLOCK = 64

# U+0001 marks matches; it is no part of any rule, and one in a text counts as U+0002, as long.
_MARK, _OTHER = "\x01", "\x02"


def _screen(rule: Rule) -> str:
    """A pattern that is found wherever the rule has a match that is kept; a cheap test before marking."""
    if rule.group == 0 and rule.least > 1 and rule.pattern.endswith("]+"):
        head, _, run = rule.pattern[:-1].rpartition("[")
        fixed = head if head.isalnum() else ""
        return f"{fixed}[{run}{{{rule.least - len(fixed)},}}" if fixed == head else rule.pattern
    return rule.pattern


def _pieces(text: Column, rule: Rule) -> Column:
    """Array of (length, kept) of a text's parts: odd ones are the rule's matches, of which the short are not kept."""
    marked = F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(_OTHER)), f"({rule.pattern})", f"{_MARK}$1{_MARK}")
    group = lambda part: F.regexp_extract(part, f"^{rule.pattern}", rule.group) if rule.group else part
    return F.transform(
        F.split(marked, _MARK),
        lambda part, i: F.struct(F.length(part).alias("length"), ((i % 2 == 1) & (F.length(group(part)) >= rule.least)).alias("kept")),
    )


def _any_gram(grams: list[str]) -> str:
    """A pattern that captures, without consuming, a trigram of the list at every position that starts one."""
    quoted = lambda c: c if c.isalnum() else "\\" + c
    tree: dict[str, dict[str, str]] = {}
    for a, b, c in grams:
        tree.setdefault(a, {}).setdefault(b, "")
        tree[a][b] += quoted(c)
    ways = (f"{quoted(a)}(?:" + "|".join(f"{quoted(b)}[{c}]" for b, c in seconds.items()) + ")" for a, seconds in tree.items())
    return f"(?=[{''.join(map(quoted, tree))}])(?=({'|'.join(ways)}))"


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, doc_id, hash) for each document and each of the trigrams that its lower-cased text holds, found in one pass."""
    present = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_any_gram(grams)), F.lit(1)))
    return docs.select("doc_id", "hash", F.explode(present).alias("gram"))


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, hash, kinds) of documents that satisfy rules' trigram queries, from the intersected postings."""
    clauses = [(r.kind, i, len(alt), g) for r in rules for i, alt in enumerate(trigram_query(r.pattern) or []) for g in alt]
    if not clauses:
        return docs.select("doc_id", "hash", F.array().cast("array<string>").alias("kinds")).filter("false")
    plan = docs.sparkSession.createDataFrame(clauses, "kind string, clause int, needed int, gram string")
    listed = materialise(postings(docs, sorted({c[3] for c in clauses})), "postings").distinct().join(F.broadcast(plan), "gram")
    met = listed.groupBy("doc_id", "hash", "kind", "clause", "needed").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.col("needed"))
    return met.groupBy("doc_id", "hash").agg(F.collect_set("kind").alias("kinds"))


def find_secrets(docs: DataFrame, rules=RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, spans (sorted array of (start, order, end, kind)).

    Positions are code points of the whole text, end exclusive; order is the
    rule's place. A null text counts as empty. Rows that repeat id and text get
    the same spans, each of them; null ids are ids like others. Empty tables give
    no rows. Other columns are ignored, so their names cannot clash.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text")).withColumn("hash", F.xxhash64("text"))
    found = materialise(candidates(rows, rules), "candidates")
    right = sized(found.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "kinds"), found)
    same = rows["doc_id"].eqNullSafe(right["_id"]) & (rows["hash"] == right["_hash"])
    if weight(found)[1] <= broadcast_limit():
        told = rows.join(right, same, "left").select("doc_id", "text", "kinds")
    else:
        # texts are shuffled only if a rule that the index serves may match them
        asks = F.lit(False)
        for rule in rules:
            if trigram_query(rule.pattern) is not None:
                asks = asks | F.col("text").rlike(_screen(rule))
        told = rows.filter(asks).join(right, same, "left").select("doc_id", "text", "kinds")
        told = told.unionByName(rows.filter(~asks).select("doc_id", "text", F.lit(None).cast("array<string>").alias("kinds")))
    none = F.array().cast("array<struct<length:int,kept:boolean>>")
    parts = []
    for order, rule in enumerate(rules):
        may = F.lit(True) if trigram_query(rule.pattern) is None else F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        own = F.when(may & F.col("text").rlike(_screen(rule)), _pieces(F.col("text"), rule)).otherwise(none)
        parts.append(F.struct(F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), own.alias("pieces")))
    # all rules of a text within its row: no shuffle, and nothing to number rows by
    return told.select("doc_id", F.array_sort(F.flatten(F.transform(F.array(*parts), _spans))).alias("spans"))


def _spans(part: Column) -> Column:
    """Array of (start, order, end, kind) of a rule's kept pieces; where a piece starts is the sum of the lengths before it.

    Sums are taken within blocks and over blocks, so a text with very many matches costs little more than its length.
    """
    pieces = part["pieces"]
    length = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + x["length"])
    starts = F.when(F.size(pieces) > 0, F.sequence(F.lit(1), F.size(pieces), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda i: F.slice(pieces, i, BLOCK))

    def placed(sums: Column) -> Column:
        def within(block: Column, k: Column) -> Column:
            before = F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0), lambda n, x: n + x)
            own = F.transform(block, lambda x, i: F.struct((length(F.slice(block, F.lit(1), i))).alias("at"), x["length"].alias("length"), x["kept"].alias("kept")))
            kept = F.filter(own, lambda x: x["kept"])
            at = lambda base: F.transform(
                kept,
                lambda x: F.struct(
                    (base + x["at"]).alias("start"), part["order"].alias("order"), (base + x["at"] + x["length"]).alias("end"), part["kind"].alias("kind")
                ),
            )
            return F.flatten(F.transform(F.array(before), at))

        return F.flatten(F.transform(blocks, within))

    some = F.exists(pieces, lambda x: x["kept"])
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    return F.when(some, F.flatten(F.transform(F.array(F.transform(blocks, length)), placed))).otherwise(none)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


QUERY = "op7_secrets_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["order"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


#: DuckDB's regular expressions give no positions; tests compare with a plain scan.
ORACLE_SQL = None
