"""Exact row numbers inside groups of any size, without one task per group."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import frozen
from .joins import fits_broadcast


def number_rows(df: DataFrame, groups: list[str], order: list[str], number: str = "number",
                total: str = "total") -> DataFrame:
    """Add each row's 1-based ``number`` by ``order`` inside ``groups``, and the group's ``total``.

    Rows are range-partitioned on groups and order, so a large group spans many sorted
    partitions. A row's number is its slot in its partition plus the group's rows in earlier
    partitions; only those per-partition counts meet in a window. The ranged rows are frozen
    first: partition numbers must not change if a task runs again. Ranging samples its input and so
    evaluates it twice: pass narrow rows, and freeze them where they are made from content.
    """
    keys = [*groups, *order]
    ranged = frozen(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
            "*",
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_slot"),
        )
    )
    whole = Window.partitionBy(*groups)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        ranged.groupBy("_part", *groups)
        .agg(F.min("_slot").alias("_first"), F.count("*").alias("_rows"))
        .select(
            "_part", *groups,
            (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
            F.sum("_rows").over(whole).alias(total),
        )
    )
    if fits_broadcast(spans):
        spans = F.broadcast(spans)
    return (
        ranged.join(spans, ["_part", *groups])
        .withColumn(number, F.col("_slot") + F.col("_shift"))
        .drop("_part", "_slot", "_shift")
    )
