"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.llm.common import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(around: DataFrame) -> DataFrame:
    """Each ``a`` with the smallest of itself and its neighbours ``b``; combined before the shuffle."""
    return around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))


def connected(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; ``component`` is the smallest node it reaches.

    Each round points the larger neighbours of a node, then the smaller ones, at the smallest; the
    rounds grow with the logarithm of the longest path. Every round is a DataFrame job over all edges
    and ends in shared storage; the driver sees one sum.
    """
    def normal(rows):
        return rows.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now, before = cut(normal(edges)), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        around = _both_ways(now)
        large = around.join(_star(around), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = normal(large)
        least = _star(large)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        now = cut(normal(small.unionAll(least.select("a", F.col("least").alias("b")))))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
