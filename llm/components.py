"""Connected components of a large graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, one: str, other: str) -> DataFrame:
    """``node`` and ``component`` (the least node reachable) for every node that has a link to another one.

    Alternates large-star and small-star steps: each node's neighbours are
    linked to the least of them, first the larger ones, then the smaller ones,
    until nothing changes.  A step needs each node's least neighbour only (an
    aggregate that is combined before the shuffle) and a join, whose hot nodes
    adaptive execution splits; no neighbourhood is gathered anywhere.  Each
    round is written to the shared folder.  Only its row count and a checksum
    come to the driver.
    """
    edges = stored(links.where(F.col(one) != F.col(other)).select(
        F.greatest(one, other).alias("u"), F.least(one, other).alias("v")).distinct())
    before = _signature(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = stored(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .union(least.select("u", "m")).distinct())
        after = _signature(edges)
        if after == before:
            break
        before = after
    root = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return root.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
