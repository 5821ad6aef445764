"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopspark.session import remove, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: every neighbour above a node goes to the node's smallest neighbour. Small: every neighbour below, and the
    node, go to the smallest. Minima are aggregates and joins, so a node with very many links is no single row or task."""
    both = links if not large else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node has one link, straight to a node that has none of its own."""
    onward = links.join(links.select(F.col("b").alias("a")), "a", "left_semi")
    return links.groupBy("a").count().where("count > 1").isEmpty() and onward.isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of at least one link. Each round is a stored table."""
    now = written(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "links")
    while not _settled(now):
        before, now = now, written(_star(_star(now, True), False), "links")
        remove(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
