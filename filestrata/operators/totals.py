"""Project totals, quick statistics, language histograms and size estimates."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import paths, scores


def _sum0(column) -> F.Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def project_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("project_id").agg(
        F.count("*").alias("total_files"),
        F.count("content").alias("text_files"),
        _sum0("size_bytes").alias("total_size_bytes"),
        _sum0("lines").alias("total_lines"),
        _sum0("words").alias("total_words"),
    )


def engine_totals(files: DataFrame) -> DataFrame:
    """Totals of the analysis model, whose line counter is the scan's line count."""
    return files.groupBy("project_id").agg(
        F.count("*").alias("files"),
        _sum0("lines").alias("sloc"),
        _sum0("size_bytes").alias("size_bytes"),
    )


def quick_stats(listing: DataFrame) -> DataFrame:
    """Statistics that need no content: it is pruned from the scan.

    Directories are counted from the distinct directory rows, so no distinct set is gathered.
    """
    path = F.col("path")
    visible = paths.is_visible(path)
    files = listing.groupBy("project_id").agg(
        F.count_if(visible).alias("total_files"),
        F.count_if(visible & paths.is_text(path)).alias("text_files"),
        F.coalesce(F.sum(F.when(visible, F.col("size_bytes"))), F.lit(0)).cast("long").alias("total_size"),
        F.count_if(paths.is_listed(path)).alias("listed_files"),
    )
    dirs = (
        listing.select("project_id", F.explode(paths.ancestors(path)).alias("dir"))
        .filter((F.col("dir") != "") & paths.is_visible(F.col("dir")))
        .distinct()
        .groupBy("project_id").agg(F.count("*").alias("directories"))
    )
    return files.join(dirs, "project_id", "left").na.fill(0, ["directories"])


def language_histogram(files: DataFrame, dialect: str = "capsule") -> DataFrame:
    return (
        files.groupBy("project_id", paths.language(F.col("path"), dialect).alias("language"))
        .agg(F.count("*").alias("n_files"), F.min("path").alias("first_path"))
    )


def dominant_language(files: DataFrame, dialect: str = "capsule") -> DataFrame:
    """The most frequent language per project; a tie goes to the one met first in path order."""
    ranked = Window.partitionBy("project_id").orderBy(F.desc("n_files"), "first_path")
    whole = Window.partitionBy("project_id")
    return (
        language_histogram(files, dialect)
        .select(
            "project_id", F.col("language").alias("dominant_language"),
            F.row_number().over(ranked).alias("place"),
            F.sum("n_files").over(whole).alias("total_files"),
            F.count("*").over(whole).alias("n_languages"),
        )
        .filter("place = 1")
        .select("project_id", "total_files", "n_languages", "dominant_language")
    )


def estimated_export(selected: DataFrame) -> DataFrame:
    sums = selected.groupBy("project_id").agg(
        F.sum("size_bytes").alias("total_bytes"), F.count("*").alias("n_files"))
    estimate = scores.estimated_size(F.col("total_bytes"), F.col("n_files"))
    return sums.select("project_id", "n_files", estimate.alias("estimated_bytes"),
                       scores.size_band(estimate).alias("band"))
