"""Connected components by alternating large and small stars, with narrow rows and no driver-side graph."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.joins import BROADCAST_BYTES, fits_broadcast, sized_join
from ..session import discard, stored


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Two numbers that tell one set of edges from another."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
    return row[0], row[1] or 0


def components(edges: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`node` and `root`, the smallest node that it can reach, for each node of the edges (`a`, `b`).

    Loops and repeated edges do no harm; rows with a null are left out; no edges give no rows. Each round hangs
    every node's larger neighbours, then its smaller ones, on the smallest node known to it; the edges have
    settled when all point at a root. Nodes are broadcast in a round if the edges are ``limit`` bytes at most; else Spark splits
    the partition of a node with very many edges.
    """
    stars = stored(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    # Every table of a round has a row per edge or node at most.
    few = fits_broadcast(stars, limit)
    before = _mark(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sized_join(both, least, ["u"], small=few).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = sized_join(large, least, ["u"], small=few).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        old, stars = stars, stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(old)
        after = _mark(stars)
        if after == before:
            break
        before = after
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out = stored(roots)
    discard(stars)
    return out
