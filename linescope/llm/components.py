"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linescope.llm.storage import saved


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b); root is the smallest node
    it reaches.

    Each round joins every node's neighbours to their least one.  Minima are
    partial aggregates and the joins back are plain, so a node with very many
    links is split like any hot join key.  Rounds grow with the logarithm of
    the longest chain; only a count and a checksum come to the driver.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = saved(edges)
    before = _mark(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(least, "a").select(F.greatest("b", "root").alias("a"), F.least("b", "root").alias("b"))
        edges = saved(small.union(least.select("a", F.col("root").alias("b"))).filter("a <> b").distinct())
        after = _mark(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
