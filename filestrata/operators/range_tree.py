"""Fingerprints as hash trees over ranges of paths: made in parallel, and compared range by range.

The leaves are a project's listing entries in path order. A node closes its range if its hash is 0 modulo ``fanout``, so ranges are cut by
content and not by count: a file that changes, comes or goes alters its own range and those above it, and leaves the others as they
were. The hashes of a range, in order, hash to its node one level up; a project is done when one node is left, its fingerprint. No task
sees more of a project than some ranges of about ``fanout`` nodes.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import frozen
from .scans import running_sums

FANOUT = 256


def _closes(hash_: Column, fanout: int) -> Column:
    return (F.conv(F.substring(hash_, 1, 8), 16, 10).cast("long") % fanout == 0).cast("int")


def leaves(listing: DataFrame) -> DataFrame:
    """``project_id, first, hash``: one node per file; ``first`` is the least path of a node's range."""
    entry = F.concat(F.col("path"), F.lit("::"), F.col("size_bytes").cast("string"))
    return listing.select("project_id", F.col("path").alias("first"), F.sha2(entry, 256).alias("hash"))


def _level_above(nodes: DataFrame, fanout: int) -> DataFrame:
    marked = nodes.select("project_id", "first", "hash", _closes(F.col("hash"), fanout).alias("closes"))
    placed = running_sums(marked, ["project_id"], ["first"], ["closes"])
    inside = F.array_sort(F.collect_list(F.struct("first", "hash")))
    return placed.groupBy("project_id", "closes_before").agg(F.min("first").alias("first"), inside.alias("nodes")).select(
        "project_id", "first", F.sha2(F.array_join("nodes.hash", ""), 256).alias("hash"), F.size("nodes").alias("n"))


def range_tree(listing: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``project_id, level, first, hash, root``: all nodes; level 0 are the files, and ``root`` marks a project's fingerprint."""
    nodes, level, out = frozen(leaves(listing).withColumn("n", F.lit(1))), 0, None
    while True:
        several = frozen(nodes.groupBy("project_id").agg((F.count("*") > 1).alias("more")))
        made = nodes.join(several, "project_id").select(
            "project_id", F.lit(level).alias("level"), "first", "hash", (~F.col("more")).alias("root"))
        out = made if out is None else out.unionByName(made)
        if not several.filter("more").take(1):
            return out
        left = nodes.join(several.filter("more").select("project_id"), "project_id", "left_semi")
        nodes, level = frozen(_level_above(left, fanout)), level + 1


def tree_fingerprint(listing: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``project_id, fingerprint, levels``; one hash over the whole listing, independent of how it is split over tasks."""
    return range_tree(listing, fanout).filter("root").select("project_id", F.col("hash").alias("fingerprint"), (F.col("level") + 1).alias("levels"))


def changed_ranges(old: DataFrame, new: DataFrame) -> DataFrame:
    """``project_id, level, first, side``: nodes of either tree whose hash the other does not have at that level.

    At level 0 these are the files that changed, were added (side ``new``) or removed (side ``old``).
    """
    keys = ["project_id", "level", "hash"]
    left, right = (side.select("project_id", "level", "first", "hash") for side in (old, new))
    gone = left.join(right.select(*keys), keys, "left_anti").withColumn("side", F.lit("old"))
    come = right.join(left.select(*keys), keys, "left_anti").withColumn("side", F.lit("new"))
    return gone.unionByName(come).select("project_id", "level", "first", "side")
