"""Connected components of links between 64-bit nodes, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import stored


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, least): every edge with the least of u and its neighbours. The minimum is taken before the join, map side first."""
    least = edges.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    found = _with_least(down)
    moved = found.select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(found.select("u", F.col("least").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(u, v): root is the least node that can be reached.

    Each round is a written table, so a lost executor costs one round; the round before it is removed. Rounds grow with the logarithm of
    the longest path. Empty links give an empty table; self-links are ignored.
    """
    edges = stored(links.where("u <> v").select("u", "v"), "links")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if tuple(state) == before or not state.n:
            break
        before = tuple(state)
        edges = stored(_small_star(_large_star(edges)), "stars", instead_of=[edges])
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
