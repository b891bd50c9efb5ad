"""Budgets of files and bytes per project."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scans import running_sums


def within_budget(files: DataFrame, max_files: int | None = None, max_size: int | None = None,
                  order: tuple[str, ...] = ("path",)) -> DataFrame:
    """Which files of each project its budget takes: ``project_id, path, size_bytes, n_before, size_before, kept``.

    Files are taken by ``order``, as long as there are ``max_files`` at most and ``max_size`` bytes in all, the file's own included. A
    limit of None is none. Only paths and sizes move; a project of any size is ranged over many tasks.
    """
    narrow = files.select("project_id", "path", "size_bytes", *[c for c in order if c not in ("path", "size_bytes")], F.lit(1).alias("n"))
    summed = running_sums(narrow, ["project_id"], [*order, *(["path"] if "path" not in order else [])], ["n", "size_bytes"])
    kept = F.lit(True)
    if max_files is not None:
        kept = kept & (F.col("n_before") < max_files)
    if max_size is not None:
        kept = kept & (F.col("size_bytes_before") + F.col("size_bytes") <= max_size)
    return summed.select("project_id", "path", "size_bytes", "n_before", F.col("size_bytes_before").alias("size_before"), kept.alias("kept"))


def budget_report(files: DataFrame, max_files: int | None = None, max_size: int | None = None) -> DataFrame:
    """Per project the files and bytes that its budget takes and leaves."""
    taken = within_budget(files, max_files, max_size)
    of = F.col("size_bytes")
    return taken.groupBy("project_id").agg(
        F.count_if("kept").alias("files_kept"), F.count_if(~F.col("kept")).alias("files_left"),
        F.coalesce(F.sum(F.when(F.col("kept"), of)), F.lit(0)).alias("bytes_kept"),
        F.coalesce(F.sum(F.when(~F.col("kept"), of)), F.lit(0)).alias("bytes_left"))


def under_budget(files: DataFrame, max_files: int | None = None, max_size: int | None = None) -> DataFrame:
    """The rows of ``files`` that their project's budget takes; content stays where it is read."""
    left = within_budget(files, max_files, max_size).filter("NOT kept").select("project_id", "path")
    return files.join(left, ["project_id", "path"], "left_anti")
