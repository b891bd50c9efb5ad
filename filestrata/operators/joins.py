"""Lookup joins that stay safe when one key holds a large share of the rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_BYTES = 32 * 1024 * 1024
SPREAD = 64


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measure ``df`` as JSON text and compare with ``limit``."""
    row = F.octet_length(F.to_json(F.struct("*"))).cast("long")
    return (df.agg(F.sum(row).alias("n")).first()["n"] or 0) <= limit


def wide_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join two tables of files by sorting both, never by a broadcast.

    Spark judges a table made from short columns by those columns: files and their facts look small at any size, and a broadcast
    would take them whole through the driver.
    """
    return rows.join(table.hint("merge"), keys, how)


def sized_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", limit: int = BROADCAST_BYTES,
               small: bool | None = None) -> DataFrame:
    """Broadcast a ``table`` that is measured as small, and sort both sides otherwise.

    Spark itself would judge a table by its compressed files, and so broadcast one that is many times its size. It splits the sorted
    partitions of hot keys, so the table is not copied for them.
    """
    if fits_broadcast(table, limit) if small is None else small:
        return rows.join(F.broadcast(table), keys, how)
    return wide_join(rows, table, keys, how)


def lookup_join(rows: DataFrame, table: DataFrame, keys: list[str], spread_by: list[str],
                how: str = "left", small: bool | None = None) -> DataFrame:
    """Join many ``rows`` to a keyed ``table`` of unique keys.

    A table measured as small is broadcast. A larger one is copied over ``SPREAD`` salts and the
    rows take a salt from ``spread_by``, so a hot key's rows meet the table in many tasks. Rounds whose
    tables have a common bound measure it once and pass the answer as ``small``.
    """
    if fits_broadcast(table) if small is None else small:
        return rows.join(F.broadcast(table), keys, how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SPREAD)).cast("int"))
    salted_table = table.withColumn("_salt", salts)
    # Spark does not count the copies: it would broadcast the salted table by the size of one.
    return wide_join(salted_rows, salted_table, [*keys, "_salt"], how).drop("_salt")
