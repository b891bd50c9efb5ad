"""Cutting texts into chunks of bounded size, at places where their structure breaks.

A unit is a line with its line feed. A chunk is a run of units of ``budget`` characters at most; a unit that is longer is a chunk by
itself. Of all such cuttings the cheapest is taken: each chunk costs ``CHUNK``, and each cut what its place costs, from 0 ahead of a
heading or a top-level definition to ``INSIDE`` between two lines of one block. Costs of the best cutting up to a line follow from
those of earlier lines within reach, so each text is solved exactly by dynamic programming, in time that grows with its
lines. Among equally cheap cuttings the one with the longest last chunk wins, then its predecessor's, and so on.
"""
from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Costs of a chunk, and of cuts: between blank-separated blocks, ahead of an indented definition, and between other lines.
CHUNK, BLOCK, NESTED, INSIDE = 10, 2, 12, 30

_TOP = re.compile(r"#{1,6} |(?:async def|def|class|function|interface|struct|impl|func|fn|@)\b|@|<h[1-6]\b|```|--- ")
_NESTED = re.compile(r"[ \t]+(?:async def|def|class|function|@)")


def units(text: str) -> list[str]:
    """The lines of a text with their line feeds."""
    return [line for line in re.split(r"(?<=\n)", text) if line]


def cut_costs(lines: list[str]) -> list[int]:
    """What it costs to cut ahead of each line."""
    costs = []
    for i, line in enumerate(lines):
        after_blank = i > 0 and not lines[i - 1].strip()
        if _TOP.match(line) and not (i and _decorates(lines[i - 1])):
            costs.append(0)
        elif after_blank and line.strip():
            costs.append(BLOCK)
        elif _NESTED.match(line) and not _decorates(lines[i - 1]):
            costs.append(NESTED)
        else:
            costs.append(INSIDE)
    return costs


def _decorates(line: str) -> bool:
    return line.lstrip(" \t").startswith("@")


def best_cuts(sizes: list[int], costs: list[int], budget: int) -> list[int]:
    """The units at which the cheapest cutting begins its chunks."""
    n = len(sizes)
    ends = np.concatenate(([0], np.cumsum(sizes))).tolist()
    total, back = [0] * (n + 1), [0] * (n + 1)
    # Starts within reach, with rising cost towards the end; the first is the cheapest, and of equals the earliest.
    reach: deque[int] = deque()
    for stop in range(1, n + 1):
        start = stop - 1
        entry = total[start] + (costs[start] if start else 0)
        while reach and total[reach[-1]] + (costs[reach[-1]] if reach[-1] else 0) > entry:
            reach.pop()
        reach.append(start)
        while reach[0] < start and ends[stop] - ends[reach[0]] > budget:
            reach.popleft()
        if ends[stop] - ends[start] > budget:
            reach.clear()
            reach.append(start)
        back[stop] = reach[0]
        total[stop] = total[reach[0]] + (costs[reach[0]] if reach[0] else 0) + CHUNK
    cuts, at = [], n
    while at:
        at = back[at]
        cuts.append(at)
    return cuts[::-1]


def cut(text: str, budget: int) -> list[int]:
    """The offsets at which a text's chunks begin; an empty text has none."""
    lines = units(text)
    offsets = np.concatenate(([0], np.cumsum([len(line) for line in lines]))).astype(int)
    return [int(offsets[i]) for i in best_cuts([len(line) for line in lines], cut_costs(lines), budget)]


def chunked(files: DataFrame, budget: int = 4000) -> DataFrame:
    """``project_id, path, chunk, start, stop, text``: the chunks of each file's content, whose texts in order are the content.

    Offsets count characters. Files without content have no chunks.
    """
    if budget < 1:
        raise ValueError("a budget is one character at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in ("project_id", "path")]
            for i in range(batch.num_rows):
                text = batch.column("content")[i].as_py()
                starts = cut(text, budget)
                stops = [*starts[1:], len(text)]
                n = len(starts)
                yield pa.RecordBatch.from_arrays([
                    *(pa.array([key[i]] * n, pa.string()) for key in keys), pa.array(range(n), pa.int64()), pa.array(starts, pa.int64()),
                    pa.array(stops[:n], pa.int64()), pa.array([text[a:b] for a, b in zip(starts, stops)], pa.string()),
                ], ["project_id", "path", "chunk", "start", "stop", "text"])

    texts = files.filter("content IS NOT NULL AND content <> ''").select("project_id", "path", "content")
    return texts.mapInArrow(run, "project_id string, path string, chunk long, start long, stop long, text string")


def reassembled(chunks: DataFrame) -> DataFrame:
    """``project_id, path, content`` from chunks in any order."""
    inside = F.array_sort(F.collect_list(F.struct("chunk", "text")))
    return chunks.groupBy("project_id", "path").agg(F.array_join(F.transform(inside, lambda c: c["text"]), "").alias("content"))
