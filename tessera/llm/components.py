"""Connected components of a graph of links, by contraction.

Each round points every node of the remaining graph at the node with most links
among its neighbours and itself, ties broken at random, and goes on with the
links between the nodes pointed at. A star is gone after one round, a chain
loses a constant share of its nodes, and a hub with many links costs no more
than those links: counts and minima are taken partially before rows move.
Pointers are then followed back round by round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut


def components(links: DataFrame) -> DataFrame:
    """links: two long columns a and b. Returns node and root, the same root for all nodes of a component; only nodes with links are there."""
    edges = cut(links.select("a", "b").filter("a != b").distinct())
    levels: list[DataFrame] = []
    seed = 0
    while not edges.isEmpty():
        seed += 1
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        degree = ends.groupBy("node").agg(F.count("*").alias("links"))
        rank = lambda c, links: F.struct((-F.col(links)).alias("few"), F.xxhash64(F.col(c), F.lit(seed)).alias("r"), F.col(c).alias("id"))
        met = ends.join(degree.select(F.col("node").alias("other"), "links"), "other")
        best = met.groupBy("node").agg(F.min(rank("other", "links")).alias("best"), F.count("*").alias("own"))
        to = cut(best.select("node", F.least(F.col("best"), rank("node", "own"))["id"].alias("root")))
        levels.append(to)
        a, b = to.select(F.col("node").alias("a"), F.col("root").alias("ra")), to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = cut(edges.join(a, "a").join(b, "b").filter("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not levels:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    out = levels[-1]
    for level in reversed(levels[:-1]):
        above = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = level.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return cut(out) if len(levels) > 1 else out
