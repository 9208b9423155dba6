"""Connected components of links between long ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.llm.common import saved


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, whatever their order."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), where root is the smallest node it is linked to.

    Large star: every node hands its smallest neighbour to its larger neighbours.
    Small star: every node ties its smaller neighbours to the smallest. Both use
    minima that are combined before the shuffle and joins to one row for each node,
    so a node with many links is no obstacle; rounds grow with the logarithm of the
    longest path. Each round is a table in the shared folder.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges, before = saved(small), mark
        mark = _mark(edges)
        if mark == before:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
