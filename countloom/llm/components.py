"""Connected components of links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node reachable.

    Every round links all neighbours of a node to the smallest of them, first the larger ones and then the
    smaller ones, until all nodes hang on their smallest one; rounds grow with the logarithm of a component.
    A node's neighbours are aggregated and joined, never gathered in one task; no links: no rows.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # larger neighbours of every node go to the smallest of its neighbourhood
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # smaller neighbours and the node itself go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        before, edges = edges, stored(small.distinct(), "edges")
        discard(before)
        if edges.select("a").intersect(edges.select("b")).isEmpty():
            break
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
