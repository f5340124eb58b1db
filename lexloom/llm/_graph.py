"""Connected components over link tables: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import Scratch


def _star(both: DataFrame, scratch: Scratch) -> DataFrame:
    """both (u, v): each node u with its least neighbour, itself included, joined to the rows of u.

    The minimum is pre-aggregated before its shuffle, and written, so that the join back can split a hub's rows."""
    least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.join(least, "u")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links (a, b) of long ids -> (node, component): the least id that links reach; nodes with a link only."""
    edges = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = scratch.save(_star(both, scratch).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _star(large, scratch)
        new = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = scratch.save(new)
        now = new.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")).first()
        for old in (edges, large):
            scratch.drop(old)
        edges = new
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
