"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """node, root: each node of links (a, b) with the smallest node it is joined to.

    Rounds of two steps, each a pre-aggregated minimum: neighbours larger than a node move to the
    node's smallest neighbour, then smaller ones do. A star's centre may have many rows, but its
    minimum is combined before the shuffle and written, so that the join can deal a large key out.
    Each round is a written table; rounds are about the logarithm of the longest chain."""
    pairs = settle(links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct())
    before = None
    while True:
        large = _to_least(pairs, True)
        small = settle(_to_least(large, False))
        state = small.agg(
            F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))
        ).first()
        if state == before:
            return small.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before, pairs = state, small


def _to_least(pairs: DataFrame, larger: bool) -> DataFrame:
    """Links (a > b). For each node, its `larger` (or else smaller) neighbours and itself are
    linked to the smallest of its neighbourhood."""
    near = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"))
    if larger:
        near = near.unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = settle(near.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least")))
    moved = near.join(least, "node")
    moved = moved.filter(F.col("other") > F.col("node")) if larger else moved.unionByName(
        least.select("node", F.col("node").alias("other"), "least")
    )
    return moved.filter("other <> least").select(
        F.col("other").alias("a"), F.col("least").alias("b")
    ).distinct()
