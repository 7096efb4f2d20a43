"""Connected components of a graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verity.llm.common import cut, discard


def _to_least(edges: DataFrame, least: DataFrame, hot: int) -> DataFrame:
    """``edges`` with the ``m`` of their ``u`` from ``least`` (u, m, d: number of edges).

    A node with more than ``hot`` edges would have them all in one task. There are few of those, as all edges
    together bound their number, so they are broadcast, and only the edges of other nodes are shuffled.
    """
    few = F.broadcast(least.where(F.col("d") > hot).select("u", F.col("m").alias("_m")))
    marked = edges.join(few, "u", "left")
    rest = marked.where("_m IS NULL").drop("_m").join(least.where(F.col("d") <= hot).select("u", "m"), "u")
    return marked.where("_m IS NOT NULL").withColumnRenamed("_m", "m").unionByName(rest)


def components(edges: DataFrame, hot: int = 1000) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long) but the roots: root is the least node that it reaches.

    Each round is made of sums by node and joins on it, and is written to the shared folder in place of the round
    before; the number of edges never grows, and the number of rounds grows with the logarithm of the longest path.
    Nothing but a count and a checksum comes to the driver. Nodes with more than ``hot`` edges, and more than a
    thousandth of all, are 2,000 at most and are broadcast. Loops and repeated edges change nothing; without
    edges there are no rows.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = cut(e)
    seen = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND((1 << 40) - 1))).first())
        if now == seen or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        limit = max(hot, now[0] // 1000)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d")).select("u", F.least("u", "m").alias("m"), "d")
        large = cut(_to_least(both.where("v > u"), least, limit).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d"))
        small = _to_least(large, least, limit).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(e)
        discard(large)
        e = done
