"""Reading the tables, and walking Arrow batches in slices of bounded size."""
from __future__ import annotations

import ctypes
import gc
import pickle
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Text that a task holds unpacked at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """`doc_id` and `text` alone, so that other columns of a table can have any names; a null text is empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def residue(key: str, divisor: int) -> Column:
    """The remainder of crc32 of the key written as text; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % divisor


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts have `limit` bytes at most, or into single rows."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if batch.num_rows > start:
            yield batch.slice(start)


def raw(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def kept(name: str, make: Callable[[], object]):
    """What a Python worker keeps between the tasks that it runs, such as a cache of encoded words."""
    store = vars(sys).setdefault("_filestrata_kept", {})
    if name not in store:
        store[name] = make()
    return store[name]


def forget() -> None:
    """Frees what earlier stages kept in this Python process, ahead of work that needs its memory and nothing of it."""
    vars(sys).pop("_filestrata_kept", None)
    gc.collect()
    pa.default_memory_pool().release_unused()
    # The C library keeps freed arrays for itself unless told to give them back; others than glibc have no such call.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))


def shared(spark: SparkSession, name: str, value: object) -> Callable[[], object]:
    """Broadcast a value of the package's classes to workers that may not have the package; call the result there to get it.

    The classes travel with the value. A worker keeps the newest value of each name.
    """
    held, key = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex

    def get() -> object:
        store = vars(sys).setdefault("_filestrata_kept", {})
        if store.get(f"shared {name}", ("",))[0] != key:
            store[f"shared {name}"] = key, pickle.loads(held.value)
        return store[f"shared {name}"][1]

    return get
