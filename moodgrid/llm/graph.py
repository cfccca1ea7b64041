"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodgrid.llm.common import staged


def _toward_least(pairs: DataFrame) -> DataFrame:
    """Each ``(u, v)`` with the least of ``u`` and all its ``v``; equal ``u`` are folded before the shuffle."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that is not its component's least.

    ``edges`` has long columns ``u`` and ``v``; loops and repeats do no harm. Each
    round hangs the larger neighbours of a node on the least one (large star), then
    the smaller ones (small star), and writes the edges; rounds go on until every
    edge ends in a root, so the number of rounds is about the logarithm of the
    longest path. A hub is a hot join key only on the side that adaptive execution
    can split: the other side has one row a node.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    now = staged(ordered.distinct(), "edges")
    while True:
        parents = now.select(F.col("v").alias("u")).distinct()
        open_ends = now.join(parents, "u", "left_semi").limit(1).count()
        split = 0 if open_ends else now.groupBy("u").count().where("count > 1").limit(1).count()
        if not open_ends and not split:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _toward_least(large)
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = small.select("u", F.col("m").alias("v"))
        now = staged(hung.unionByName(kept).where("u <> v").distinct(), "edges")
