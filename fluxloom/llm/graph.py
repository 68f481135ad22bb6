"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node of a link and the smallest node that links reach from it.

    Each round takes the smallest label among the neighbours and then the label's own label, so that long chains halve;
    it ends when a round changes nothing. Links and labels stay distributed, each round in a table of its own.
    """
    both = cut_lineage(links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(b, a)).distinct(), "links")
    labels = cut_lineage(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = cut_lineage(lower.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter("label < old").isEmpty():
            return labels
