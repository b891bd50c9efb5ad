"""Running sums and running automaton states over ordered rows, without one task per group.

Rows are range-partitioned on groups and order, so a large group spans many sorted partitions. Each partition is walked once from an
unknown start; what it does to a start is one narrow row per partition and group. Only those rows meet, and tell every
partition of a group where it starts. The walked rows are frozen: partitions must not change if a task runs again. Ranging samples
its input and so evaluates it twice: freeze rows that are costly to make. Rows that are equal in groups and order
come in no fixed order.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import frozen
from .joins import fits_broadcast

Walk = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]]


def _walked(df: DataFrame, keys: list[str], added: str, walk: Walk) -> DataFrame:
    """The rows in order by partition, with the columns that ``walk`` adds, ``_slot`` and ``_part``."""
    names = [*df.columns, *(field.split()[0] for field in added.split(", ")), "_slot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = 0
        for batch, columns in walk(batches):
            slots = pa.array(np.arange(slot, slot + batch.num_rows, dtype=np.int64))
            slot += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, slots], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    in_order = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return frozen(in_order.mapInArrow(run, f"{schema}, {added}, _slot long").withColumn("_part", F.spark_partition_id()))


def _with_spans(rows: DataFrame, spans: DataFrame, groups: list[str]) -> DataFrame:
    if fits_broadcast(spans):
        spans = F.broadcast(spans)
    same = (rows["_part"] == spans["_part"]) if not groups else None
    for group in groups:
        met = rows[group].eqNullSafe(spans[group])
        same = met if same is None else same & met
    same = same & (rows["_part"] == spans["_part"])
    return rows.join(spans.select("*"), same).drop(spans["_part"], *(spans[g] for g in groups))


def running_sums(df: DataFrame, groups: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Add ``<column>_before`` for each of the whole-numbered ``columns``: its sum over the group's earlier rows by ``order``.

    A null counts as 0.
    """
    def walk(batches):
        total = np.zeros(len(columns), dtype=np.int64)
        for batch in batches:
            out = []
            for i, c in enumerate(columns):
                sums = np.cumsum(np.append(total[i], batch.column(c).cast(pa.int64()).fill_null(0).to_numpy()))
                total[i] = sums[-1]
                out.append(pa.array(sums[:-1]))
            yield batch, out

    local = [f"_run{i}" for i in range(len(columns))]
    rows = _walked(df, [*groups, *order], ", ".join(f"{c} long" for c in local), walk)
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("_part", *groups).agg(*[
        x for c, run in zip(columns, local)
        for x in (F.min_by(run, "_slot").alias(f"_first{run}"), F.coalesce(F.sum(c), F.lit(0)).alias(f"_sum{run}"))])
    starts = spans.select("_part", *groups, *[
        (F.coalesce(F.sum(f"_sum{run}").over(earlier), F.lit(0)) - F.col(f"_first{run}")).alias(f"_start{run}") for run in local])
    return _with_spans(rows, starts, groups).select(
        *df.columns, *[(F.col(run) + F.col(f"_start{run}")).alias(f"{c}_before") for c, run in zip(columns, local)])


def running_states(df: DataFrame, groups: list[str], order: list[str], step: str, maps: list[list[int]], state: str = "state") -> DataFrame:
    """Add the ``state`` that an automaton is in before each row of a group by ``order``; every group starts in state 0.

    Row by row it goes from state s to ``maps[step][s]``, where ``step`` is a column of numbers. What a run of rows does to each
    possible start is such a map too, so partitions compose theirs without knowing where they start.
    """
    n = len(maps[0])
    identity = tuple(range(n))
    table = [tuple(m) for m in maps]

    def walk(batches):
        last, current = None, identity
        after: dict[tuple, tuple] = {}
        for batch in batches:
            heads = list(zip(*(batch.column(g).to_pylist() for g in groups)))
            before = []
            for head, code in zip(heads, batch.column(step).to_pylist()):
                if head != last:
                    last, current = head, identity
                before.append(current)
                moved = after.get((current, code))
                if moved is None:
                    moved = after[current, code] = tuple(table[code][s] for s in current)
                current = moved
            yield batch, [pa.array(before, pa.list_(pa.int32()))]

    rows = _walked(df, [*groups, *order], "_map array<int>", walk)
    ends = rows.groupBy("_part", *groups).agg(F.max_by(F.struct("_map", step), "_slot").alias("_end"))
    steps = F.array(*[F.array(*map(F.lit, m)) for m in maps])
    whole = F.transform("_end._map", lambda s: F.get(F.get(steps, F.col(f"_end.{step}").cast("int")), s))
    spans = ends.select("_part", *groups, whole.alias("_whole"))

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_part")
        starts, at = [], 0
        for moved in group["_whole"]:
            starts.append(at)
            at = int(moved[at])
        return group.drop(columns="_whole").assign(_start=np.array(starts, dtype=np.int32))

    # A group has one row per partition here.
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.schema if f.name != "_whole")
    starts = frozen(spans.groupBy(*groups).applyInPandas(chain, f"{types}, _start int"))
    return _with_spans(rows, starts, groups).select(*df.columns, F.get("_map", F.col("_start")).alias(state))
