"""Filters, selections and attachments on the (project_id, path) key."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, paths
from .joins import wide_join

KEY = ["project_id", "path"]


def visible_files(files: DataFrame) -> DataFrame:
    return files.filter(paths.is_visible(F.col("path")))


def size_tiers(files: DataFrame, drop_above: int = fixed.DROP_ABOVE,
               read_limit: int = fixed.READ_LIMIT) -> DataFrame:
    """Drop giant files; keep the unread row of a large one."""
    large = F.col("size_bytes") > read_limit
    kept = files.filter(F.col("size_bytes") <= drop_above)
    unread = large & F.col("content").isNotNull()
    return kept.withColumns({
        "content": F.when(unread, "").otherwise(F.col("content")),
        "lines": F.when(~unread | F.col("content").isNull(), F.col("lines")),
        "words": F.when(~unread | F.col("content").isNull(), F.col("words")),
        "read_status": F.when(unread, "large").otherwise(F.col("read_status")),
    })


def apply_selection(files: DataFrame, selection: DataFrame | None) -> DataFrame:
    """Keep every row, and the content of selected paths only; no selection keeps all content.

    A project without a selected path loses all its content.
    """
    if selection is None:
        return files
    chosen = selection.filter("selected").select(*KEY, F.lit(True).alias("_chosen"))
    return (
        files.join(chosen, KEY, "left")
        .withColumn("content", F.when(F.col("_chosen"), F.col("content")))
        .drop("_chosen")
    )


def selected_files(files: DataFrame, selection: DataFrame) -> DataFrame:
    return files.join(selection.filter("selected").select(*KEY), KEY, "left_semi")


def without_exclusions(files: DataFrame, exclusions: DataFrame) -> DataFrame:
    return files.join(exclusions.select(*KEY), KEY, "left_anti")


def stored_exclusions(selection: DataFrame) -> DataFrame:
    """The exclusion list a selection saves: every path that is not plainly selected."""
    return selection.filter(~F.coalesce(F.col("selected"), F.lit(False))).select(*KEY)


def attach_content(analysis: DataFrame, files: DataFrame) -> DataFrame:
    return wide_join(analysis, files.select(*KEY, "content", "lines", "words"), KEY)


def with_content(files: DataFrame, dialect: str) -> DataFrame:
    """``present`` keeps empty texts, ``filled`` wants at least one character."""
    content = F.col("content")
    return files.filter(content.isNotNull() if dialect == "present" else content != "")
