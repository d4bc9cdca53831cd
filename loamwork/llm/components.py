"""Connected components by alternating large and small stars, in DataFrame functions.

Each step keeps the components and moves edges towards their least node; the edges, a few at most for each
node, are checkpointed after each round.  A hub's neighbours are never gathered: least neighbours are
aggregated before the exchange, and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import shared_checkpoint


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least_neighbour(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbour(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node reachable) for every node of the edges (u, v)."""
    now = shared_checkpoint(edges.select("u", "v").filter("u != v").distinct())
    seen = None
    while True:  # stars settle, in rounds that grow as a logarithm, when the edges, as a set, no longer change
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        seen = mark
        now = shared_checkpoint(_small_star(_large_star(now)))
