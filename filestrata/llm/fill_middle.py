"""Fill-in-the-middle documents, cut at token boundaries that a learned rank index finds.

A text is a run of units, and a cut is a rank: so many units come before it. The index maps ranks to character offsets. It is
fitted to all boundaries of a text: a segment starts at a boundary and takes in further ones as long as some line through its
start stays within `epsilon` characters of each of them, so offsets are a piecewise-linear function of ranks plus residuals of
one byte. A cut is looked up by the segment that its rank falls in, the offset that the segment's line predicts, and the stored
residual, which makes the offset exact.

Null and empty texts have no units and stay as they are, as do texts that hold one of the marks; both are `plain`. A null id
draws as an empty one does, and rows that repeat an id draw the same numbers. Rows come back as often as they went in; an empty
table gives an empty result, and other columns play no part.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import frames

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The farthest that a segment's line may be from a boundary; with rounding, a residual then fits a signed byte.
EPSILON = 126
#: Boundaries that a growing segment looks at first; each further look takes twice as many.
_REACH = 256

_LETTER = np.zeros(128, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def boundaries(text: str) -> np.ndarray:
    """The offsets before, between and after the units `[A-Za-z]+|[^A-Za-z]` of a text, in code points."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _LETTER[np.minimum(codes, 127)] & (codes < 128)
    begins = ~letter
    begins[1:] |= ~letter[:-1]
    begins[:1] = True
    return np.append(np.flatnonzero(begins), len(codes))


@dataclass(frozen=True)
class RankIndex:
    """Segment i covers the ranks from `starts[i]` on, along the line from `offsets[i]` with the slope `slopes[i]`."""

    starts: np.ndarray
    offsets: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    def predicted(self, ranks) -> np.ndarray:
        ranks = np.asarray(ranks)
        at = np.searchsorted(self.starts, ranks, side="right") - 1
        return self.offsets[at] + np.rint(self.slopes[at] * (ranks - self.starts[at])).astype(np.int64)

    def offset(self, ranks) -> np.ndarray:
        """The exact offset of each rank."""
        return self.predicted(ranks) + self.residuals[ranks]


def _segment(known: np.ndarray, start: int, epsilon: int) -> tuple[int, float]:
    """Where the longest segment from `start` ends, and the slope of its line."""
    low, high, stop, reach = -np.inf, np.inf, start + 1, _REACH
    while stop < len(known):
        ranks = np.arange(stop, min(stop + reach, len(known)))
        rise = known[ranks] - known[start]
        lows = np.maximum(np.maximum.accumulate((rise - epsilon) / (ranks - start)), low)
        highs = np.minimum(np.minimum.accumulate((rise + epsilon) / (ranks - start)), high)
        wrong = lows > highs
        fit = int(wrong.argmax()) if wrong.any() else len(ranks)
        if fit:
            low, high = lows[fit - 1], highs[fit - 1]
        stop += fit
        if fit < len(ranks):
            break
        reach *= 2
    return stop, 0.0 if stop == start + 1 else (low + high) / 2


def fitted(known: np.ndarray, epsilon: int = EPSILON) -> RankIndex:
    """The index of all `known` offsets, which rise."""
    starts, slopes, at = [], [], 0
    while at < len(known):
        stop, slope = _segment(known, at, epsilon)
        starts.append(at)
        slopes.append(slope)
        at = stop
    starts = np.array(starts)
    line = RankIndex(starts, known[starts], np.array(slopes), np.zeros(0))
    residuals = known - line.predicted(np.arange(len(known)))
    narrow = np.int8 if epsilon <= EPSILON else np.int32
    return RankIndex(starts, line.offsets, line.slopes, residuals.astype(narrow))


def draws(key: str, seed: int = 1) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of an id."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4))


@dataclass(frozen=True)
class Options:
    """`plain` and `spm` are percents: of documents left as they are, and of the others those with the suffix first."""

    seed: int = 1
    plain: int = 10
    spm: int = 20
    epsilon: int = EPSILON


def cut(text: str, key: str, options: Options) -> tuple[int, str, int | None, int | None, str, int]:
    """`n, form, prefix_chars, middle_chars, output` of a text, and the segments of its index."""
    known = boundaries(text)
    n = len(known) - 1
    index = fitted(known, options.epsilon)
    h1, h2, h3, h4 = draws(key, options.seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - options.plain:
        return n, "plain", None, None, text, len(index.starts)
    first, last = (int(x) for x in index.offset(sorted((h1 % (n + 1), h2 % (n + 1)))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if h4 % 100 < options.spm:
        return n, "spm", first, last - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", len(index.starts)
    return n, "psm", first, last - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", len(index.starts)


def transformed(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """`doc_id, n, form, prefix_chars, middle_chars, output, n_segments` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames.slices(batches, "text"):
            rows = [cut(text, "" if key is None else str(key), options)
                    for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())]
            n, form, prefix, middle, output, segments = map(list, zip(*rows))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), frames.longs(n), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                pa.array(middle, pa.int64()), pa.array(output, pa.string()), frames.longs(segments),
            ], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "n_segments"])

    return frames.texts(docs).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, n_segments long")


def _split(text: Column, mark: str) -> tuple[Column, Column]:
    """What comes before and after the first mark."""
    before = F.substring_index(text, mark, 1)
    return before, F.substr(text, F.length(before) + len(mark) + 1)


def restored(outputs: DataFrame) -> DataFrame:
    """All columns of `outputs`, and `restored`, the text behind each `output` of its `form`; another form gives null.

    A text that was cut holds no mark, and no mark can begin inside another, so each is where it is first found.
    """
    output, form = F.col("output"), F.col("form")
    head, middle = _split(output, MIDDLE)
    body = F.substr(head, F.lit(len(PREFIX) + 1))
    prefix, suffix = _split(body, SUFFIX)
    last, first = _split(body, PREFIX)
    text = F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(first, middle, last))
    return outputs.withColumn("restored", text)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every document is cut, with the digests of its transformed text and of what that restores to."""
    return restored(transformed(frames.table(spark, sf_dir, "documents"))).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"))


OP13_SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
         CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4
  FROM units
), cuts AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                 WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS c1, greatest(h1 % (n + 1), h2 % (n + 1)) AS c2
  FROM drawn
), parts AS (
  SELECT *, array_to_string(u[1:c1], '') AS p, array_to_string(u[c1 + 1:c2], '') AS m, array_to_string(u[c2 + 1:], '') AS s FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
