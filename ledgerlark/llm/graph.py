"""Connected components of a link table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(edges: DataFrame) -> DataFrame:
    """Written, so that a join with it is one of two plain shuffles, which can be split at a node of many links."""
    return cut(edges.groupBy("a").agg(F.min("b").alias("least")))


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for each node of links (a, b).

    Every round is two keyed aggregations and joins over the links alone, written to the shared
    folder; rounds grow with the logarithm of a component's width. Self links and repeated links
    are harmless, nulls are dropped; no links give no rows.
    """
    edges = cut(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()
        least = _least(large)
        small = large.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = cut(small.unionByName(least.select("a", F.col("least").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
