"""Benchmark decontamination with DataFrame functions alone.

The benchmark's normalised windows (13 consecutive words; the whole item if it
has fewer) form a hash set that is broadcast while its counted size is within
bounds. Probing every word of every document would make a row for each word, so a
document is probed at every s-th word only: a window of L words holds L - k + 1
grams of k words, and with s = L - k + 1 one of them starts at a multiple of s. A
gram that is found proposes the few windows around it, which are then compared
word by word. Every occurrence of every window is found, in one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, repeated_rows, sized, table

WINDOW = 13
#: Letters and digits of ASCII, and every other character from U+0080 on.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Documents with hits in at least this share of their words are contaminated.
CONTAMINATED_ONE_IN = 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Distinct windows: length, words (array), items (sorted ids as strings)."""
    item = benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"), words(F.col(text_column)).alias("w"))
    size = F.size("w")
    length = F.least(F.lit(WINDOW), size)
    starts = F.sequence(F.lit(1), size - length + 1)
    cut = item.filter(size > 0).select("item", length.alias("length"), F.explode(F.transform(starts, lambda i: F.slice("w", i, length))).alias("words"))
    return cut.groupBy("length", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _gram(length: int) -> tuple[int, int]:
    """Words of a gram, and the stride at which documents are probed, for windows of length words."""
    k = (length + 1) // 2
    return k, length - k + 1


def _covered(spans: str) -> Column:
    """Words under sorted (start, end) spans, end exclusive."""
    zero = F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(
        F.greatest(a["end"], s["stop"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["end"]))).alias("n"),
    )
    return F.aggregate(F.array_sort(F.col(spans)), zero, step, lambda a: a["n"])


def _hits(docs: DataFrame, benchmark: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, hash, copies, n_words, spans, items): a row for each distinct id and text, with the rows that have them."""
    windows = materialise(benchmark_windows(benchmark, text_column="text"), "windows")
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most WINDOW values
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("hash"), "text")

    # For each length, (length, first word, key) of the grams at multiples of the stride; one more for the document itself.
    grams = [windows.filter("false").select(F.lit(0).alias("length"), F.lit(0).cast("long").alias("key"))]
    # That one meets nothing; its key is the document's hash, so that a join that shuffles spreads them.
    probes = [F.array(F.struct(F.lit(0).alias("length"), F.lit(0).alias("at"), F.col("hash").alias("key")))]
    for n in lengths:
        k, stride = _gram(n)
        held = F.explode(F.transform(F.sequence(F.lit(1), F.lit(stride)), lambda i: F.slice("words", i, k))).alias("g")  # noqa: B023
        grams.append(windows.filter(F.col("length") == n).select(held).select(F.lit(n).alias("length"), F.xxhash64(F.lit(n), "g").alias("key")))
        at = F.when(F.size("w") >= n, F.sequence(F.lit(stride), F.size("w") - k + 1, F.lit(stride)) if stride > 1 else F.sequence(F.lit(1), F.size("w") - k + 1))
        probe = F.transform(at, lambda i: F.struct(F.lit(n).alias("length"), i.cast("int").alias("at"), F.xxhash64(F.lit(n), F.slice("w", i, k)).alias("key")))  # noqa: B023
        probes.append(F.coalesce(probe, F.array().cast("array<struct<length:int,at:int,key:long>>")))
    known = sized(materialise(reduce(DataFrame.unionByName, grams).distinct(), "grams")).withColumn("known", F.lit(True))
    told = rows.select("doc_id", "hash", words(F.col("text")).alias("w")).select("doc_id", "hash", F.size("w").alias("n_words"), F.explode(F.concat(*probes)).alias("p"))
    found = told.select("doc_id", "hash", "n_words", "p.*").join(known, ["length", "key"], "left").filter((F.col("length") == 0) | F.col("known"))
    probed = found.groupBy("doc_id", "hash").agg(
        F.count(F.when(F.col("length") == 0, 1)).alias("copies"),
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("length") > 0, F.struct("length", "at"))).alias("probes"),
    )
    probed = materialise(probed, "probed")

    # The windows of that length that hold the gram start at most stride - 1 words before it; their words are fetched now.
    asked = sized(materialise(probed.filter(F.size("probes") > 0).select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "probes"), "asked"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    held = rows.join(asked, same).select("doc_id", "hash", "probes", words(F.col("text")).alias("w"))

    def proposed(p: Column) -> Column:
        length, at = p["length"], p["at"]
        first = F.greatest(F.lit(1), at - (length - F.floor((length + 1) / 2).cast("int")))
        last = F.least(at, F.size("w") - length + 1)
        starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(length.alias("length"), i.alias("start"), F.slice("w", i, length).alias("words")))

    # one array of windows, so that the whole text is not repeated for each of them
    cut = held.select("doc_id", "hash", F.explode(F.array_distinct(F.flatten(F.transform("probes", proposed)))).alias("c"))
    cut = cut.select("doc_id", "hash", "c.length", "c.start", "c.words", F.xxhash64("c.length", "c.words").alias("key"))
    told = windows.select(F.xxhash64("length", "words").alias("key"), F.col("length").alias("k_length"), F.col("words").alias("k_words"), "items")
    told = sized(materialise(told, "told"))
    verified = cut.join(told, "key").filter((F.col("length") == F.col("k_length")) & (F.col("words") == F.col("k_words")))
    verified = verified.groupBy(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("stop")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    verified = sized(materialise(verified, "verified"))
    return probed.join(verified, same, "left").select(
        "doc_id",
        "hash",
        "copies",
        "n_words",
        F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, spans, items.

    spans: sorted distinct (start, stop) word positions of windows that occur,
    stop exclusive; items: sorted ids of the benchmark items that have them, as
    strings (a null id is the empty string). Null and empty texts have no words
    and no hits, and so have all texts if the benchmark is empty. Rows that repeat
    an id or a text get a result each. Items that repeat a text are all named.
    Empty tables give no rows. Other columns are ignored, so their names cannot
    clash.
    """
    return repeated_rows(_hits(docs, benchmark, id_column, text_column), "copies").drop("hash")


def _judged(hits: DataFrame) -> DataFrame:
    hits = hits.withColumn("n_hit", _covered("spans"))
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (CONTAMINATED_ONE_IN * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """benchmark_hits with n_hit (words inside any occurrence) and contaminated."""
    return _judged(benchmark_hits(docs, benchmark))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns.

    Each row is judged by its own text, so rows that share an id, or have none, go
    or stay by themselves. Null and empty texts stay; empty tables stay empty.
    """
    bad = _judged(_hits(docs, benchmark, "doc_id", "text")).filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"))
    right = sized(materialise(bad, "contaminated"))
    same = docs["doc_id"].eqNullSafe(right["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == right["_hash"])
    return docs.join(right, same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and the text, for each row of docs, without the benchmark's words: each span that is hit becomes one space.

    The text is rebuilt from its words and the separators between them, so all
    that is not hit stays as it is. Each row loses the spans of its own text, also
    where rows share an id or have none. Null texts become empty; empty tables
    give no rows.
    """
    spans = _hits(docs, benchmark, "doc_id", "text").filter(F.size("spans") > 0)
    right = sized(materialise(spans.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "spans"), "spans"))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    joined = rows.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left")
    joined = joined.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")))
    kept = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same words, either case
    parts = joined.withColumn("w", F.regexp_extract_all("text", F.lit(kept), F.lit(0))).withColumn("gaps", F.split("text", kept))
    hit = lambda i: F.exists("spans", lambda s: (s["start"] <= i + 1) & (i + 1 < s["stop"]))
    rebuilt = F.transform(
        F.col("gaps"),
        lambda g, i: F.concat(
            F.when((i > 0) & (i < F.size("w")) & hit(i - 1) & hit(i), F.lit(" ")).otherwise(g),
            F.when((i < F.size("w")) & ~hit(i), F.coalesce(F.get("w", i), F.lit(""))).otherwise(F.lit("")),
        ),
    )
    return parts.select("doc_id", F.array_join(rebuilt, "").alias("text"))


QUERY = "op3_decontaminate"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item, w, least(13, len(w)) AS length FROM item WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item, length, array_to_string(w[i : i + length - 1], ' ') AS words
  FROM (SELECT item, w, length, unnest(range(1, len(w) - length + 2)) AS i FROM sized)
),
lengths AS (SELECT DISTINCT length FROM win),
cut AS (
  SELECT doc_id, length, i, array_to_string(w[i : i + length - 1], ' ') AS words
  FROM (SELECT doc_id, w, length, unnest(range(1, len(w) - length + 2)) AS i FROM doc CROSS JOIN lengths WHERE len(w) >= length)
),
hit AS (SELECT doc_id, i, cut.length AS length, item FROM cut JOIN win ON cut.length = win.length AND cut.words = win.words),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + length)) AS p FROM hit) GROUP BY doc_id
),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
