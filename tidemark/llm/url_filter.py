"""URL filtering by mined token combinations, under hand-made rules.

Spark's FP-growth mines which combinations of URL tokens go with the label
`block` among labelled pages; tokens that always go together are one item. Rules
are pruned by confidence and support, and a rule goes if a part of its items does
as well. Every rule is listed under its rarest item's tokens; a url looks up its
tokens in that inverted index and verifies the few rules that it finds.
"""

from __future__ import annotations

import json

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, lookup, materialise, sized, table

#: Fixed rules: (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Of the labelled pages: the least share that a rule's tokens and label have, and that of its tokens' pages with the label.
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.8
BLOCK = "label:block"

_PARTS = r"^(?s).*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits the host or a parent domain and starts the path; else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens_of(url: Column) -> Column:
    """Distinct tokens: the host's labels, the path's segments, the query's names; numbers are alike."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    part = lambda kind, pieces: F.transform(F.filter(pieces, lambda x: x != ""), lambda x: F.concat(F.lit(kind), F.regexp_replace(x, "[0-9]+", "0")))
    named = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    all_parts = F.concat(part("host:", F.split(host_of(url), r"\.")), part("path:", F.split(path_of(url), "/")), part("query:", named))
    return F.coalesce(F.array_distinct(all_parts), F.array().cast("array<string>"))


def mine_classes(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(classes, confidence, support) from labelled (tokens, blocked), all rows; the rarest class comes first.

    A class holds the tokens that stand on the very same labelled pages; they are
    mined as one item, so tokens that always go together don't multiply. A rule
    needs one token, whichever, of each of its classes. Support and confidence
    count all labelled rows, those without a known token too. Every token that is
    in enough blocked pages for a rule is mined, however weak it is alone; there
    are at most a page's tokens over min_support of them. Equal sets of pages are
    told by two sums of 64-bit hashes. No labelled rows, or none blocked, give no
    rules.
    """
    spark = labelled.sparkSession
    labelled = materialise(labelled.select("tokens", "blocked", F.monotonically_increasing_id().alias("row")), "labelled")
    total, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("blocked").cast("long")), F.lit(0))).first()
    empty = spark.createDataFrame([], "classes array<array<string>>, confidence double, support double")
    if not blocked:
        return empty
    same = [F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(38,0)")).alias(f"sum{seed}") for seed in (1, 2)]
    stats = (
        labelled.select("blocked", "row", F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("pages"), F.sum(F.col("blocked").cast("long")).alias("hits"), *same)
        .filter(F.col("hits") >= min_support * total)
        .collect()
    )
    sets: dict[tuple, list[str]] = {}
    for r in stats:
        sets.setdefault((r["pages"], r["sum1"], r["sum2"]), []).append(r["token"])
    if not sets:
        return empty
    # an item is its class's least token
    held = {min(tokens): (key[0], sorted(tokens)) for key, tokens in sets.items()}
    item_of = F.from_json(F.lit(json.dumps({t: item for item, (_, tokens) in held.items() for t in tokens})), "map<string,string>")
    label = F.when(F.col("blocked"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))
    own = F.array_distinct(F.filter(F.transform("tokens", lambda t: F.element_at(item_of, t)), lambda x: x.isNotNull()))
    rules = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(labelled.select(F.concat(own, label).alias("items"))).associationRules
    rules = rules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK))
    pages = F.from_json(F.lit(json.dumps({item: n for item, (n, _) in held.items()})), "map<string,long>")
    ranked = F.transform(F.array_sort(F.transform("antecedent", lambda t: F.struct(F.element_at(pages, t).alias("n"), t.alias("t")))), lambda x: x["t"])
    rules = materialise(rules.select(ranked[0].alias("anchor"), ranked.alias("items"), "confidence", "support"), "rules")
    # a rule goes if fewer of its items do as well; the lesser rule's anchor is among its items
    lesser = rules.select(F.col("anchor").alias("item"), F.col("items").alias("fewer"), F.col("confidence").alias("as_sure"))
    covered = (
        rules.filter(F.size("items") > 1).select("items", "confidence", F.explode("items").alias("item"))
        .join(lesser, "item")
        .filter((F.size("fewer") < F.size("items")) & (F.col("as_sure") >= F.col("confidence")) & (F.size(F.array_except("fewer", "items")) == 0))
        .select("items")
        .distinct()
    )
    tokens_of_item = F.from_json(F.lit(json.dumps({item: tokens for item, (_, tokens) in held.items()})), "map<string,array<string>>")
    kept = rules.join(covered, "items", "left_anti")
    return kept.select(F.transform("items", lambda t: F.element_at(tokens_of_item, t)).alias("classes"), "confidence", "support")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, confidence, support): mine_classes written out, a row for each choice of a token from each class."""
    none = F.array(F.array().cast("array<string>"))
    each = F.aggregate("classes", none, lambda made, own: F.flatten(F.transform(made, lambda m: F.transform(own, lambda t: F.concat(m, F.array(t))))))
    rules = mine_classes(labelled, min_support, min_confidence).select(F.explode(each).alias("tokens"), "confidence", "support")
    return rules.withColumn("tokens", F.array_sort("tokens"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, mined (the page's least tokens of the mined rule's classes, or null).

    Labels are those of labels' rows whose doc_id is the page_id; toxic = 1 means
    block. The longest fixed rule decides; else the mined rule of most confidence,
    which blocks; else the page is allowed. Null urls and those without :// have
    an empty host and path and no tokens, and are allowed. Rows are kept apart
    even if they repeat. Without labels nothing is mined. Other columns, html
    among them, are not read, so their names cannot clash.
    """
    urls = pages.select("page_id", "url")
    toxic = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg((F.max("toxic") == 1).alias("blocked"))
    labelled = urls.join(toxic.filter(F.col("blocked").isNotNull()), "page_id").select(tokens_of(F.col("url")).alias("tokens"), "blocked")
    mined = materialise(mine_classes(labelled), "mined")
    # the inverted index: a rule stands under each token of its rarest class
    index = mined.select(F.explode(F.col("classes")[0]).alias("token"), "classes", "confidence")
    index = sized(materialise(index, "index"))

    # a mined rule looks at the url alone, so each url is matched once, and only those that match are kept
    probed = urls.filter("url IS NOT NULL").select("url").distinct().withColumn("tokens", tokens_of(F.col("url")))
    found = probed.select("*", F.explode("tokens").alias("token")).join(index, "token").filter(F.forall("classes", lambda own: F.arrays_overlap(own, F.col("tokens"))))
    named = F.array_sort(F.transform("classes", lambda own: F.array_min(F.array_intersect(own, F.col("tokens")))))
    matched = materialise(found.select("url", "confidence", named.alias("mined")).groupBy("url").agg(F.max(F.struct("confidence", "mined")).alias("best")), "matched")
    judged = lookup(urls, matched, ["url"]).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "best")
    fixed = judged.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    return fixed.select(
        "page_id",
        "host",
        "path",
        F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", F.when(F.col("best").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.array_join("best.mined", " ").alias("mined"),
    )


QUERY = "op1_url_filter"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


#: Mining is not SQL; tests compare with a brute-force count of token combinations.
ORACLE_SQL = None
