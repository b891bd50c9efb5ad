"""Churn: lines that come and go between snapshots of files tables.

Files of equal hash did not change; that is seen from narrow rows. Only texts of files that did meet, each with its successor alone. Of
two texts the lines of a longest common subsequence stay; the others of the old one are removed and those of the new one added.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

KEY = ["project_id", "path"]


def common_lines(old: list[str], new: list[str]) -> int:
    """The length of a longest common subsequence.

    Lines at both ends that agree are in one, and lines of one side only in none; the rest is compared by bit rows: of each line
    of the old text one bit, which a line of the new text moves all at once.
    """
    start = 0
    while start < min(len(old), len(new)) and old[start] == new[start]:
        start += 1
    stop = 0
    while stop < min(len(old), len(new)) - start and old[-1 - stop] == new[-1 - stop]:
        stop += 1
    old, new = old[start:len(old) - stop], new[start:len(new) - stop]
    both = set(old) & set(new)
    old, new = [x for x in old if x in both], [x for x in new if x in both]
    places: dict[str, int] = {}
    for i, line in enumerate(old):
        places[line] = places.get(line, 0) | 1 << i
    every = (1 << len(old)) - 1
    row = every
    for line in new:
        met = row & places[line]
        row = ((row + met) | (row - met)) & every
    return start + stop + len(old) - row.bit_count()


def lines_of(text: str | None) -> list[str]:
    """A text's lines; a line feed at the end ends the last one."""
    if not text:
        return []
    return text.removesuffix("\n").split("\n")


def _compared(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``old`` and ``new`` in place of texts: the lines of each, and those common."""
    kept = [c for c in pairs.columns if c not in ("old", "new")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for old, new in zip(batch.column("old"), batch.column("new")):
                a, b = lines_of(old.as_py()), lines_of(new.as_py())
                counts.append((len(a), len(b), common_lines(a, b)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array([x[i] for x in counts], pa.int64()) for i in range(3))],
                [*kept, "n_old", "n_new", "n_common"])

    return pairs.select(*kept, "old", "new").mapInArrow(run, f"{fields}, n_old long, n_new long, n_common long")


def line_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``project_id, path, status, added, removed`` of every file of two snapshots.

    ``status`` is added, removed, changed or same. Files without content have no lines.
    """
    def narrow(files: DataFrame, name: str) -> DataFrame:
        text = F.coalesce("content", F.lit(""))
        n = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(text.endswith("\n"), 0).otherwise(1))
        return files.select(*KEY, F.sha2(text, 256).alias(f"{name}_hash"), n.cast("long").alias(f"{name}_lines"))

    both = narrow(old, "old").join(narrow(new, "new"), KEY, "full")
    status = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(
        F.col("old_hash") == F.col("new_hash"), "same").otherwise("changed")
    listed = both.select(*KEY, status.alias("status"), "old_lines", "new_lines")
    plain = listed.filter("status <> 'changed'").select(
        *KEY, "status", F.when(F.col("status") == "added", F.col("new_lines")).otherwise(F.lit(0)).cast("long").alias("added"),
        F.when(F.col("status") == "removed", F.col("old_lines")).otherwise(F.lit(0)).cast("long").alias("removed"))
    changed = listed.filter("status = 'changed'").select(*KEY, "status")
    texts = changed.join(old.select(*KEY, F.coalesce("content", F.lit("")).alias("old")), KEY).join(
        new.select(*KEY, F.coalesce("content", F.lit("")).alias("new")), KEY)
    compared = _compared(texts).select(
        *KEY, "status", (F.col("n_new") - F.col("n_common")).alias("added"), (F.col("n_old") - F.col("n_common")).alias("removed"))
    return plain.unionByName(compared)


def churn(snapshots: DataFrame) -> DataFrame:
    """``project_id, path, versions, added, removed`` over all successive ``version``s of each file of (project_id, path, version, content).

    A file's versions are ordered in a window of its own, and each meets the one before it.
    """
    before = Window.partitionBy(*KEY).orderBy("version")
    pairs = snapshots.select(*KEY, "version", F.coalesce("content", F.lit("")).alias("new")).withColumn(
        "old", F.lag("new").over(before)).withColumn("old", F.coalesce("old", F.lit("")))
    changed = _compared(pairs.filter("old <> new").select(*KEY, "old", "new"))
    sums = changed.groupBy(*KEY).agg(F.sum(F.col("n_new") - F.col("n_common")).alias("added"), F.sum(F.col("n_old") - F.col("n_common")).alias("removed"))
    listed = snapshots.groupBy(*KEY).agg(F.count("*").alias("versions"))
    zero = F.lit(0).cast("long")
    return listed.join(sums, KEY, "left").select(
        *KEY, "versions", F.coalesce("added", zero).alias("added"), F.coalesce("removed", zero).alias("removed"))


def churn_hotspots(files: DataFrame, changes: DataFrame) -> DataFrame:
    """``project_id, path, size_bytes, churn, hotspot``: a file's size in bytes times its added and removed lines."""
    moved = changes.select(*KEY, (F.col("added") + F.col("removed")).alias("churn"))
    found = files.select(*KEY, "size_bytes").join(moved, KEY, "left")
    lines = F.coalesce("churn", F.lit(0).cast("long"))
    return found.select(*KEY, "size_bytes", lines.alias("churn"), (F.col("size_bytes") * lines).alias("hotspot"))
