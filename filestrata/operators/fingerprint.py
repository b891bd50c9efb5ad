"""Project fingerprints: one SHA-256 over a project's ordered listing."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .numbering import number_rows

CHUNK = 4096


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feed each project's chunks, which arrive sorted, to one running hash."""
    project, state = None, None

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"project_id": project, "fingerprint": state.hexdigest()}],
            schema=pa.schema([("project_id", pa.string()), ("fingerprint", pa.string())]))

    for batch in batches:
        for owner, text in zip(batch.column("project_id"), batch.column("chunk")):
            if owner.as_py() != project:
                if state is not None:
                    yield closed()
                project, state = owner.as_py(), hashlib.sha256()
            state.update(text.as_py().encode("utf-8"))
    if state is not None:
        yield closed()


def project_fingerprint(listing: DataFrame, by_components: bool = False) -> DataFrame:
    """SHA-256 of ``path::size`` entries ordered by path string, or by path components.

    Order and entry text are made in parallel: entries are numbered, then joined into chunks of
    bounded length. SHA-256 itself is sequential, so a project's chunks, which hold its listing
    and never its content, run through one streaming hash that keeps a few bytes of state.
    """
    path = F.col("path")
    order = F.split(path, "/") if by_components else path
    entries = listing.select(
        "project_id", order.alias("place"),
        F.concat(path, F.lit("::"), F.col("size_bytes").cast("string")).alias("entry"))
    numbered = number_rows(entries, ["project_id"], ["place"])
    chunks = (
        numbered.groupBy("project_id", F.floor((F.col("number") - 1) / CHUNK).alias("chunk_no"))
        .agg(F.array_sort(F.collect_list(F.struct("number", "entry"))).alias("entries"))
        .select("project_id", "chunk_no",
                F.array_join(F.col("entries.entry"), "").alias("chunk"))
    )
    return (
        chunks.repartition("project_id").sortWithinPartitions("project_id", "chunk_no")
        .select("project_id", "chunk")
        .mapInArrow(_fold, "project_id string, fingerprint string")
    )
