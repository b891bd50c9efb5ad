"""Hash trees over a project's ordered content hashes."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import frozen

SPAN = 10  # levels built per shuffle: groups of at most 2**SPAN hashes


def _depth(total: Column) -> Column:
    """Levels above the leaves: the bits of ``total - 1``."""
    return F.when(total <= 1, 0).otherwise(F.length(F.bin(total - 1)))


def _paired(hashes: Column) -> Column:
    """The next level: SHA-256 of each neighbouring pair's text, a last odd one alone."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / 2).cast("int")),
        lambda i: F.sha2(F.concat(
            F.get(hashes, i * 2), F.coalesce(F.get(hashes, i * 2 + 1), F.lit(""))), 256),
    )


def _node_id(total: Column, level: Column, idx: Column) -> Column:
    """Running number over the levels in turn; level ``j`` holds ``ceil(total / 2**j)`` nodes."""
    def width(acc: Column, j: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1).cast("long"), j)
        return acc + F.floor((total + step - 1) / step)

    before = F.when(level <= 1, F.lit(0).cast("long")).otherwise(
        F.aggregate(F.sequence(F.lit(1), level - 1), F.lit(0).cast("long"), width))
    return F.format_string("n-%04d", before + idx + 1)


def _climb(level: DataFrame) -> DataFrame:
    """Build up to SPAN levels over each aligned block of hashes, in one shuffle."""
    steps = F.least(F.lit(SPAN), _depth(F.col("total")) - F.col("level"))
    blocks = (
        level.withColumn("steps", steps).filter("steps > 0")
        .groupBy("project_id", "total", "level", "steps",
                 F.shiftright(F.col("idx"), SPAN).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("leaves"))
    )
    built = F.aggregate(
        F.sequence(F.lit(1), F.col("steps")),
        F.struct(F.col("leaves.hash").alias("cur"),
                 F.array().cast("array<array<string>>").alias("done")),
        lambda acc, _: F.struct(
            _paired(acc["cur"]).alias("cur"),
            F.concat(acc["done"], F.array(acc["cur"])).alias("done")),
        lambda acc: F.concat(acc["done"], F.array(acc["cur"])),
    )
    rows = blocks.select("project_id", "total", "level", "steps", "block",
                         F.posexplode(built).alias("up", "hashes")).filter("up > 0")
    first = F.call_function(
        "shiftright", F.call_function("shiftleft", F.col("block"), F.lit(SPAN)), F.col("up"))
    return (
        rows.select("project_id", "total", (F.col("level") + F.col("up")).alias("level"),
                    (F.col("up") == F.col("steps")).alias("is_top"), first.alias("first"),
                    F.posexplode("hashes").alias("offset", "hash"))
        .select("project_id", "total", "level", "is_top",
                (F.col("first") + F.col("offset")).alias("idx"), "hash")
    )


def hash_tree(leaves: DataFrame) -> DataFrame:
    """Inner nodes of every project's tree from (project_id, idx from 0, total, hash) leaves.

    A project of one file has no inner node; its leaf is the root (see ``tree_root``).
    """
    level = leaves.select("project_id", "total", F.lit(0).alias("level"), "idx", "hash")
    largest = leaves.agg(F.max("total").alias("n")).first()["n"] or 0
    built: list[DataFrame] = []
    for _ in range(0, (max(largest, 1) - 1).bit_length(), SPAN):
        climbed = frozen(_climb(level))
        built.append(climbed)
        level = climbed.filter("is_top").drop("is_top")
    if not built:
        built.append(_climb(level))
    nodes = reduce(DataFrame.unionByName, built)
    return nodes.select(
        "project_id", "level", "idx",
        _node_id(F.col("total"), F.col("level"), F.col("idx")).alias("node_id"), "hash")


def tree_root(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """The top node's hash; for one file its own hash; for no file the hash of ''."""
    single = leaves.filter("total = 1").select("project_id", F.lit(0).alias("level"), "hash")
    tops = (
        nodes.select("project_id", "level", "hash").unionByName(single)
        .groupBy("project_id").agg(F.max_by("hash", "level").alias("root"))
    )
    return tops.select("project_id", "root")


def empty_root() -> Column:
    return F.sha2(F.lit(""), 256)
