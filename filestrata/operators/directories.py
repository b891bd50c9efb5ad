"""Roll-ups over the directory tree that the paths imply."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..session import frozen


def _above(files: DataFrame, *columns: str) -> DataFrame:
    path = F.col("path")
    return files.select(
        "project_id", *columns, paths.parent(path).alias("own_dir"),
        F.explode(paths.ancestors(path)).alias("dir"),
    )


def _parent_of(directory: Column) -> Column:
    return F.when(directory != "", paths.parent(directory))


def directory_rollup(files: DataFrame) -> DataFrame:
    """One row per directory: its parent, its files at any depth and its direct children.

    Partial sums run before the shuffle, so a project's root is one row per task. Children are
    counted, not listed: the list is this table itself, filtered on ``parent``. The directories
    are frozen before their children are counted, so the paths are exploded once.
    """
    tree = frozen(
        _above(files, "size_bytes").groupBy("project_id", "dir")
        .agg(
            F.count("*").alias("n_files"),
            F.sum("size_bytes").alias("bytes"),
            F.count_if(F.col("own_dir") == F.col("dir")).alias("n_direct_files"),
        )
        .withColumn("parent", _parent_of(F.col("dir")))
    )
    children = (
        tree.filter("parent IS NOT NULL").groupBy("project_id", F.col("parent").alias("dir"))
        .agg(F.count("*").alias("n_subdirs"))
    )
    return tree.join(children, ["project_id", "dir"], "left").na.fill(0, ["n_subdirs"]).select(
        "project_id", "dir", "parent", "n_files", "bytes", "n_direct_files", "n_subdirs")


def selection_rollup(selection: DataFrame) -> DataFrame:
    """Tri-state of every directory: ``all``, ``none`` or ``mixed``."""
    chosen = F.coalesce(F.col("selected"), F.lit(False))
    return (
        _above(selection.withColumn("selected", chosen), "selected")
        .groupBy("project_id", "dir")
        .agg(F.bool_and("selected").alias("_every"), F.bool_or("selected").alias("_some"))
        .select("project_id", "dir",
                F.when(F.col("_every"), "all").when(F.col("_some"), "mixed").otherwise("none").alias("state"))
    )
