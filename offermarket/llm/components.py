"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offermarket.skew import hot_join
from offermarket.staging import stage


def _state(links: DataFrame) -> tuple:
    """Number of links and a checksum of them: equal for equal link tables."""
    key = F.xxhash64("a", "b")
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(key), F.sum(key.cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage(both.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n_rows")), "neighbours")
    joined = hot_join(both, least.select("a", "low"), least.select("a", "n_rows"), ["a"], ["b"])
    moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("low", "a").alias("b"))
    return stage(moved.distinct(), "links")


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = stage(links.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n_rows")), "neighbours")
    joined = hot_join(links, least.select("a", "low"), least.select("a", "n_rows"), ["a"], ["b"])
    moved = joined.filter(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return stage(moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for the nodes that are not the smallest of their component.

    ``links`` has columns ``a`` and ``b`` of one orderable type; direction, repeats and
    links of a node to itself don't matter. The label is the smallest node. Steps
    repeat until the links are stars around the labels, after few rounds for any shape;
    nodes with very many links are split over tasks.
    """
    ordered = links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = stage(ordered.distinct(), "links")
    state = _state(now)
    while state[0]:
        now = _small_star(_large_star(now))
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
