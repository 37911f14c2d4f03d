"""Connected components over a table of links, by joins and aggregations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup, materialise, measured, renamed


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b); component is the smallest node it reaches.

    Each round every node takes the least label of its neighbours, hands it on to
    the node that its own label names, and then takes its label's label, so the
    number of rounds grows with the logarithm of a component's diameter. Each round
    is written to the shared folder, and the tables of the round before are
    deleted. A node with many links, and a label that many nodes share, are met by
    partial aggregation, or by a lookup that salts hot keys.
    Self-links and repeated links do no harm; no links, no rows.
    """
    ends = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = materialise(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links", links)
    mark = F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels", both, mark=mark)
    while True:
        near = lookup(both, labels.withColumnRenamed("node", "v"), ["v"], labels).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        seen = labels.join(near, "node")
        handed = seen.select("node", F.least("label", "near").alias("label")).unionByName(seen.select(F.col("label").alias("node"), F.col("near").alias("label")))
        hooked = materialise(handed.groupBy("node").agg(F.min("label").alias("label")), "hooked", both)
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("above"))
        before = labels
        labels = materialise(lookup(hooked, up, ["label"], hooked).select("node", F.least("label", "above").alias("label")), "labels", both, mark=mark)
        same = measured(before, "mark") == measured(labels, "mark")
        discard(before, hooked)
        if same:
            discard(both)
            return renamed(labels, label="component")
