"""Arithmetic scores and their bands."""
from pyspark.sql import Column, functions as F


def risk_score(complexity: Column, sloc: Column, markers: Column) -> Column:
    return complexity + sloc / 200 + markers * 0.5


def risk_band(score: Column) -> Column:
    return (
        F.when(score.isNull(), "not-computed")
        .when(score < 5, "low")
        .when(score < 15, "medium")
        .otherwise("high")
    )


def hotspot(complexity: Column, markers: Column) -> Column:
    return F.least(complexity * 0.1 + markers * 0.2, F.lit(10.0))


def estimated_size(total_bytes: Column, n_files: Column) -> Column:
    return F.floor(total_bytes * F.lit(1.1)).cast("long") + 256 * n_files


def size_band(estimate: Column) -> Column:
    return (
        F.when(estimate < 1024 * 1024, "small")
        .when(estimate < 10 * 1024 * 1024, "medium")
        .otherwise("large")
    )
