"""Connected components of links by joins: least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.shared import dropped, written


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, comp): the least node reachable, for each node that has a link.

    Each round takes the least label among neighbours and then that label's own label, so that a star is done after
    one round and a path of n nodes after about log2(n).  The hub of a large group is a key of many rows on the
    aggregated side only (a partial minimum) or of one row on the side that AQE does not need to split."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        least = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        fresh = written(least.join(up, "comp", "left").select("node", "old", F.least(F.col("comp"), F.coalesce("up", "comp")).alias("comp")), "labels")
        changed = not fresh.filter("comp <> old").isEmpty()
        dropped(labels)
        labels = fresh
        if not changed:
            dropped(both)
            return labels
