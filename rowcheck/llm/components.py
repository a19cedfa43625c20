"""Connected components of a graph of 64-bit nodes by alternating large and small stars.

Each round is two group-by-minimum steps (combined before the shuffle) and joins on the node, so a
node with very many neighbours never meets in one task as a group; Spark splits its rows in the join.
The graph shrinks to stars in a number of rounds that grows with the logarithm of its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowcheck.llm.common import cut


def _least(edges: DataFrame) -> DataFrame:
    """u, m: the smallest of u and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge points from the larger node u to the smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, root): root is the smallest node reachable; roots themselves and nodes without an edge are their own root and not listed.

    Loops are ignored; an edge may be given in either direction and more than once. An empty table gives an empty result.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen, now = mark, cut(_small_star(_large_star(now)))
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
