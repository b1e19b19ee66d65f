"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.session import materialise


def followed(pointers: DataFrame, name: str) -> DataFrame:
    """(node, root) after following (node, root) pointers to their ends. Pointers only lead to smaller nodes."""
    while True:
        ahead = pointers.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        further = pointers.join(ahead, "root").select("node", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("_moved"))
        further = materialise(further, name)
        pointers = further.select("node", "root")
        if further.where("_moved").isEmpty():
            return pointers


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b); the root is the smallest node of the component.

    A round points every node to its smallest neighbour if that is smaller, follows the pointers to their roots
    and replaces the links by those between roots. Every node that is no root of its neighbourhood disappears, so
    the links run out after a number of rounds logarithmic in the size of the largest component. All tables of a
    round are stored ones: joins on a hub are plain shuffles, which adaptive execution splits, and minima are
    partially aggregated.
    """
    both = links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct()
    both = materialise(both, "links")
    labels = None
    while True:
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_least"))
        pointers = materialise(least.select("node", F.least("node", "_least").alias("root")), "pointers")
        roots = followed(pointers, "roots")
        if labels is None:
            labels = roots
        else:
            onward = roots.select(F.col("node").alias("root"), F.col("root").alias("_onward"))
            labels = labels.join(onward, "root", "left").select("node", F.coalesce("_onward", "root").alias("root"))
            labels = materialise(labels, "labels")
        a = roots.select(F.col("node").alias("a"), F.col("root").alias("_a"))
        b = roots.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        both = materialise(
            both.join(a, "a").join(b, "b").where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(),
            "links",
        )
        if both.isEmpty():
            return labels
