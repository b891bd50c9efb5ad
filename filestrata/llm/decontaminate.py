"""Benchmark decontamination by latent semantic retrieval, confirmed by common subsequences.

Words are runs of letters and digits in lower case, hashed into `BUCKETS` terms; a term's weight is its inverse document
frequency over all documents. Items are dealt into spaces of at most `RANK` items of like length. The latent space of each is the randomised
singular value decomposition of its TF-IDF passages, with a direction for each item: a space of fewer directions than items, or one
fitted to the corpus, would spend its rank on what all share and lose the rare terms that tell one item from another. Both passes over
the passages are distributed; the driver holds a matrix of the items' terms x `RANK` for each space.

Every document is covered by overlapping windows, one size for each class of item lengths, such that a passage
of an item's length lies whole in one of them. Windows whose latent cosine with an item reaches `COSINE`, or `SHORT_COSINE` for items of fewer than `SHORT` words, are
candidates if they have `ENERGY` of its vector along it, and nothing else is; tests measure which share of verbatim and changed passages they hold. A candidate is a leak if the longest
common subsequence has at least `SIMILARITY` of the item's words and the item's answer (a column `answer`, or else its last sentence) is
found to at least a half, or if nearly all of the item is there. Items of fewer than five words must be there whole. Items of fewer than
`SHORT` words must be found in a run of about their length, as a window holds many short subsequences by chance.

Spaces are met in passes over the documents, `SPACES` in each, so that what tasks hold is bounded. Null and empty
documents are clean; null and empty items match nothing. Rows of documents come back as often as they went in; each is
judged by its own text, whatever its id.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import frames
from .words import Words

BUCKETS, RANK, EXTRA = 1 << 15, 256, 8
#: Spaces that are met in one pass.
SPACES = 4
_SHIFT = np.uint64(64 - 15)
COSINE, SIMILARITY, NEARLY_ALL, ANSWER = 0.15, 0.75, 0.9, 0.5
#: The share of an item's vector that a window has along it at least; with a direction for each item, a whole item has all of it.
ENERGY = 0.3
#: Words of short items, and the cosine for these: a window holds much besides.
SHORT, SHORT_COSINE = 12, 0.1
_STEP = 8
_SLICE = 1 << 20
#: Words of one run of windows; longer texts come in parts that overlap by more than a window.
_RUN = 32_768
#: Cells of the table that bounds an item's words in a window, as a power of two, and places that are looked up at a time.
_CELLS, _EXPANDED = 19, 500_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _cells(item: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The cell of each pair of an item's place and a term."""
    return (item.astype(np.uint64) << np.uint64(15) | terms.astype(np.uint64)) * _SPREAD >> np.uint64(64 - _CELLS)


def _words(texts: list[str]) -> Words:
    return Words([t.lower().encode() for t in texts], alnum=True)


def _terms(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _SHIFT).astype(np.int64)


def _documents_of_terms(terms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """In how many texts each term occurs; the texts have `sizes` of the terms, in order."""
    met = np.sort(np.repeat(np.arange(len(sizes)), sizes) * BUCKETS + terms)
    return np.bincount(met[np.flatnonzero(np.diff(met, prepend=-1))] % BUCKETS, minlength=BUCKETS)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames.forget()
        total, n = np.zeros(BUCKETS + 1, dtype=np.int64), 0
        for batch in frames.slices(batches, "text", _SLICE):
            words = _words(batch.column("text").to_pylist())
            total[:-1] += _documents_of_terms(_terms(words.hashes), words.counts())
            n += batch.num_rows
        total[-1] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([frames.longs(at), frames.longs(total[at])], ["term", "n"])

    # One row per term at most, and one for the number of documents.
    rows = frames.texts(docs).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(BUCKETS + 1, dtype=np.int64)
    for row in rows:
        total[row["term"]] = row["n"]
    return total[:-1], int(total[-1])


def _summed(passages: DataFrame, idf: np.ndarray, used: np.ndarray, inner: list[np.ndarray], gram: bool) -> list[np.ndarray]:
    """Per space the sum over its passages a of outer(a, a @ inner), or with `gram` of outer(a @ inner, a @ inner).

    Matrices have a row for each of the terms `used`, which are in order.
    """
    # Only rows of terms that occur in the space are sent.
    rows_of = [np.flatnonzero(right.any(axis=1)) for right in inner]
    shared = passages.sparkSession.sparkContext.broadcast((idf[used], used, [(at, right[at]) for at, right in zip(rows_of, inner)]))
    n = len(used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, used, sent = shared.value
        rights = [np.zeros((n, part.shape[1])) for _, part in sent]
        for right, (at, part) in zip(rights, sent):
            right[at] = part
        for batch in frames.slices(batches, "text"):
            words, spaces = _words(batch.column("text").to_pylist()), np.asarray(batch.column("space"))
            for space in np.unique(spaces).tolist():
                right = rights[space]
                total = np.zeros((right.shape[1] if gram else n, right.shape[1]))
                for i in np.flatnonzero(spaces == space):
                    terms, tf = np.unique(_terms(words.hashes[words.first[i]:words.first[i + 1]]), return_counts=True)
                    terms = np.searchsorted(used, terms)
                    a = tf * weights[terms]
                    a = a / max(1e-12, np.linalg.norm(a))
                    y = a @ right[terms]
                    if gram:
                        total += np.outer(y, y)
                    else:
                        total[terms] += np.outer(a, y)
                at = np.flatnonzero(total.any(axis=1))
                yield pa.RecordBatch.from_arrays([
                    frames.longs(np.full(len(at), space)), frames.longs(at), pa.array([row.tobytes() for row in total[at]], pa.binary()),
                ], ["space", "place", "row"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        summed = rows.groupby(["space", "place"])["row"].agg(
            lambda v: np.sum([np.frombuffer(x) for x in v], axis=0).tobytes())
        return summed.reset_index()

    schema = "space long, place long, row binary"
    rows = passages.select("space", "text").mapInArrow(run, schema).groupBy("space", F.col("place") % 16).applyInPandas(add, schema).collect()
    totals = [np.zeros((right.shape[1] if gram else n, right.shape[1])) for right in inner]
    for row in rows:
        totals[row["space"]][row["place"]] = np.frombuffer(row["row"])
    return totals


def latent_spaces(passages: DataFrame, idf: np.ndarray, used: np.ndarray, n: int, rank: int, seed: int = 3) -> list[np.ndarray]:
    """For each of `n` spaces the leading right singular vectors (a row for each of the terms `used`) of its passages' TF-IDF matrix.

    `passages` are (space, text), and `used` are all terms of theirs, in order. The range finder multiplies by random numbers, then by what that gives.
    """
    start = np.random.default_rng(seed).standard_normal((len(used), rank + EXTRA))
    bases = []
    for total in _summed(passages, idf, used, [start] * n, gram=False):
        # Terms of no passage of the space have no part in the basis.
        at = np.flatnonzero(total.any(axis=1))
        directions = np.linalg.qr(total[at])[0]
        basis = np.zeros((len(used), directions.shape[1]))
        basis[at] = directions
        bases.append(basis)
    out = []
    for basis, gram in zip(bases, _summed(passages, idf, used, bases, gram=True)):
        values, turn = np.linalg.eigh(gram)
        best = np.argsort(values)[::-1][:rank]
        out.append(basis @ turn[:, best[values[best] > 1e-9]])
    return out


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence, a machine word of `a` at a time in one integer."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for x in b.tolist():
        met = row & places.get(x, 0)
        if met:
            row = (row + met | row - met) & full
    return len(a) - row.bit_count()


@dataclass(frozen=True)
class Item:
    id: int
    words: np.ndarray
    answer: np.ndarray
    text: str = ""

    def found(self, words: np.ndarray) -> float:
        """The share of the item that is in the words if that makes a leak, else 0."""
        # As the index's bound, but for words in place of terms.
        there = set(words.tolist())
        if sum(map(there.__contains__, self.words.tolist())) < SIMILARITY * len(self.words):
            return 0.0
        common = common_subsequence(self.words, words)
        share = common / len(self.words)
        if len(self.words) < 5 or share >= NEARLY_ALL:
            return share if share >= (1 if len(self.words) < 5 else NEARLY_ALL) else 0.0
        if share < SIMILARITY or len(self.answer) and common_subsequence(self.answer, words) < ANSWER * len(self.answer):
            return 0.0
        return share

    def found_near(self, words: np.ndarray) -> float:
        """As `found`, but a short item must be in a run of at most a quarter more than its words."""
        n = len(self.words)
        if n >= SHORT:
            return self.found(words)
        span = n if n < 5 else n + n // 4
        return max(self.found(words[i:i + span]) for i in range(max(1, len(words) - span + 1)))


def read_items(benchmark: DataFrame) -> list[Item]:
    """The items of one pass."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.filter("text IS NOT NULL").select("item_id", "text", answer.alias("answer")).collect()
    items = []
    for row in rows:
        last = re.split(r"(?<=[.!?])\s+", row["text"].strip())[-1]
        words, answer_words = _words([row["text"]]).hashes, _words([row["answer"] or last]).hashes
        if len(words):
            items.append(Item(row["item_id"], words, answer_words, row["text"]))
    return sorted(items, key=lambda item: (len(item.words), item.words.tobytes()))


def length_class(n: int) -> int:
    """The smallest of 8, 12, 16, 24, 32, 48, ... that is at least n."""
    size = 8
    while size < n:
        size = size * 3 // 2 if size & (size - 1) == 0 else size // 3 * 4
    return size


@dataclass(frozen=True)
class Index:
    """Latent vectors of a space's terms, already weighted, and its items with their unit vectors by length class.

    `row` leads from a term to its vector in `terms`, whose last row is 0, and is -1 for terms of no item. `classes` have the window's size, the items'
    first place, the items and their vectors. `weights` has in the cell of an item and a term how many of the item's words have
    the term; pairs that share a cell are added up. `norms` are the lengths of the items' vectors.
    """

    row: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    classes: list[tuple[int, int, list[Item], np.ndarray]]
    norms: list[np.ndarray]

    @staticmethod
    def of(items: list[Item], idf: np.ndarray, space: np.ndarray, rows: np.ndarray | None = None) -> "Index":
        """`space` has a row for each term, or for each of the terms `rows`, which are in order."""
        used = np.unique(np.concatenate([_terms(item.words) for item in items]))
        row = np.full(BUCKETS, -1, dtype=np.int32)
        row[used] = np.arange(len(used))
        terms = (idf[used, None] * space[used if rows is None else np.searchsorted(rows, used)]).astype(np.float32)
        by_class: dict[int, list[Item]] = {}
        for item in items:
            by_class.setdefault(length_class(len(item.words)), []).append(item)
        classes, norms, weights, place = [], [], np.zeros(1 << _CELLS, dtype=np.int32), 0
        for size, members in sorted(by_class.items()):
            vectors = np.stack([terms[row[_terms(item.words)]].sum(axis=0) for item in members])
            norms.append(np.maximum(1e-9, np.linalg.norm(vectors, axis=1)).astype(np.float32))
            classes.append((size, place, members, (vectors / norms[-1][:, None]).astype(np.float32)))
            for item in members:
                np.add.at(weights, _cells(np.full(len(item.words), place), _terms(item.words)), 1)
                place += 1
        return Index(row, np.vstack([terms, np.zeros_like(terms[:1])]), weights, classes, norms)

    def _at_most(self, item: np.ndarray, terms: np.ndarray, before: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """For each pair of an item and a run of `terms`, no fewer than the item's words that are in the run.

        `before` is where the same term was met last; a term counts where the run has it first.
        """
        out = np.zeros(len(item), dtype=np.int64)
        cuts = np.searchsorted(np.cumsum(stop - start), np.arange(_EXPANDED, int((stop - start).sum()) + _EXPANDED, _EXPANDED)) + 1
        a = 0
        for b in cuts.tolist():
            length = (stop - start)[a:b]
            ends = np.cumsum(length)
            pair = np.repeat(np.arange(a, a + len(length)), length)
            places = np.arange(len(pair)) - np.repeat(ends - length, length) + start[pair]
            pair, places = (v[before[places] < start[pair]] for v in (pair, places))
            out[a:b] = np.bincount(pair - a, self.weights[_cells(item[pair], terms[places])], len(length))
            a = b
        return out

    def leaks(self, words: Words, n: int) -> list[dict[int, float]]:
        """Per text the items that it holds, with the share found."""
        found: list[dict[int, float]] = [{} for _ in range(n)]
        overlap = 2 * max(size for size, _, _, _ in self.classes)
        length = max(_RUN, 2 * overlap)
        run: list[tuple[int, int, int]] = []
        for text in range(n):
            begin, end = int(words.first[text]), int(words.first[text + 1])
            while begin < end:
                stop = min(end, begin + length)
                if run and stop - begin + sum(b - a for _, a, b in run) > length:
                    self._leaks(words, run, found)
                    run = []
                run.append((text, begin, stop))
                begin = stop if stop == end else stop - overlap
        if run:
            self._leaks(words, run, found)
        return found

    def _leaks(self, words: Words, run: list[tuple[int, int, int]], found: list[dict[int, float]]) -> None:
        """As `leaks`, for some parts of texts; each is (text, first word, last word and one)."""
        owner = np.array([text for text, _, _ in run])
        hashes = np.concatenate([words.hashes[a:b] for _, a, b in run])
        first = np.cumsum([0, *(b - a for _, a, b in run)])
        steps = -(-np.diff(first) // _STEP)
        n_steps = int(steps.sum())
        first_step = np.cumsum(steps) - steps
        text_of = np.repeat(np.arange(len(run)), steps)
        begin = first[text_of] + _STEP * (np.arange(n_steps) - first_step[text_of])
        terms = _terms(hashes)
        at = np.flatnonzero(self.row[terms] >= 0)
        met = terms[at]
        vectors_of = self.row[met]
        # A run is short, so that single precision holds its sums.
        summed = np.zeros((n_steps + 1, self.terms.shape[1]), dtype=np.float32)
        step = np.searchsorted(begin, at, side="right") - 1
        # The vector of each place of each step; the last is nothing's.
        vector = np.full((_STEP, n_steps), len(self.terms) - 1)
        vector[at - begin[step], step] = vectors_of
        held = np.empty_like(summed)
        for places in vector:
            summed[1:] += np.take(self.terms, places, axis=0, mode="clip", out=held[1:])
        np.cumsum(summed, axis=0, out=summed)
        order = np.argsort(met, kind="stable")
        before = np.full(len(at), -1)
        before[order[1:]] = np.where(met[order[1:]] == met[order[:-1]], order[:-1], -1)
        in_text = np.arange(n_steps) - first_step[text_of]
        for (size, place, members, vectors), item_norms in zip(self.classes, self.norms):
            stride = max(1, size // 2 // _STEP)
            width = -(-size // _STEP) + stride
            starts = np.flatnonzero(in_text % stride == 0)
            ends = np.minimum(starts + width, (first_step + steps)[text_of[starts]])
            x = np.take(summed, ends, axis=0, mode="clip", out=held[:len(starts)])
            x -= summed[:-1] if stride == 1 else summed[starts]
            norms = np.maximum(1e-9, np.sqrt(np.einsum("ij,ij->i", x, x)))
            lows = np.maximum(first[text_of[starts]], begin[starts] - size // 4)
            highs = np.minimum(first[text_of[starts] + 1], begin[starts] + width * _STEP + size // 4)
            first_met, last_met = np.searchsorted(at, lows), np.searchsorted(at, highs)
            least = np.array([SIMILARITY * len(item.words) for item in members])
            reach = np.where(least < SIMILARITY * SHORT, SHORT_COSINE, COSINE).astype(np.float32)
            along = x @ vectors.T
            window, item = np.nonzero(along >= np.maximum(reach * norms[:, None], ENERGY * item_norms))
            # No subsequence is longer than the number of the item's words that are there at all.
            enough = self._at_most(place + item, met, before, first_met[window], last_met[window]) >= least[item]
            for w, i in zip(window[enough].tolist(), item[enough].tolist()):
                of_text, key = found[owner[text_of[starts[w]]]], members[i].id
                if of_text.get(key, 0.0) < 1:
                    share = members[i].found_near(hashes[lows[w]:highs[w]])
                    if share:
                        of_text[key] = max(share, of_text.get(key, 0.0))


def spaces_of(items: list[Item]) -> list[list[Item]]:
    """Runs of items of like length, as even as can be, of at most `RANK` items."""
    n = -(-len(items) // RANK)
    return [items[len(items) * i // n:len(items) * (i + 1) // n] for i in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`doc_id, contaminated, items, similarity, mark` of each document: the items found in it and the best share of one.

    `mark` is a hash of the text, which tells rows of one id apart.
    """
    # The driver gives back what it was lent for models of earlier stages.
    frames.forget()
    frequency, n_docs = document_frequencies(docs)
    idf = np.log((n_docs + 1) / (frequency + 1)) + 0.01
    passes = max(1, -(-benchmark.count() // (SPACES * RANK)))
    parts = []
    for number in range(passes):
        part = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number) if passes > 1 else benchmark
        spaces = spaces_of(read_items(part))
        if not spaces:
            continue
        # An item's text goes to its space; there are few items in a pass.
        dealt = docs.sparkSession.createDataFrame(
            [(space, item.text) for space, items in enumerate(spaces) for item in items], "space long, text string")
        used = np.unique(np.concatenate([_terms(item.words) for items in spaces for item in items]))
        vectors = latent_spaces(dealt.repartition(8), idf, used, len(spaces), max(map(len, spaces)))
        index = frames.shared(docs.sparkSession, f"benchmark {number}", [Index.of(items, idf, space, used) for items, space in zip(spaces, vectors)])

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in frames.slices(batches, "text", _SLICE):
                words = _words(batch.column("text").to_pylist())
                found: list[dict[int, float]] = [{} for _ in range(batch.num_rows)]
                for space in index():
                    for of_text, more in zip(found, space.leaks(words, batch.num_rows)):
                        of_text.update(more)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), batch.column("mark"), pa.array([sorted(x for x in f if x is not None) for f in found], pa.list_(pa.int64())),
                    pa.array([max(f.values(), default=0.0) for f in found], pa.float64()),
                ], ["doc_id", "mark", "items", "similarity"])

        parts.append(frames.texts(docs, _mark()).mapInArrow(run, "doc_id long, mark long, items array<long>, similarity double"))
    if not parts:
        none = F.array().cast("array<long>")
        return docs.select("doc_id", F.lit(False).alias("contaminated"), none.alias("items"), F.lit(0.0).alias("similarity"), _mark())
    found = parts[0]
    if len(parts) > 1:
        # Rows of one id and text hold the same items; each pass's answer for them is taken once.
        keys = F.struct("doc_id", "mark").alias("key")
        more = [part.filter("similarity > 0").select(keys, "items", "similarity").dropDuplicates(["key"]) for part in parts[1:]]
        others = reduce(DataFrame.unionByName, more).groupBy("key").agg(
            F.flatten(F.collect_list("items")).alias("more"), F.max("similarity").alias("best"))
        none = F.array().cast("array<long>")
        found = found.withColumn("key", keys).join(others, "key", "left").select(
            "doc_id", "mark", F.concat("items", F.coalesce("more", none)).alias("items"), F.greatest("similarity", F.coalesce("best", F.lit(0.0))).alias("similarity"))
    return found.select("doc_id", (F.col("similarity") > 0).alias("contaminated"), "items", "similarity", "mark")


def _mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds."""
    return contamination(frames.table(spark, sf_dir, "documents"), frames.table(spark, sf_dir, "benchmark")).drop("mark")


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of `docs` that hold no item.

    Null and empty texts stay. Rows with a null id, and rows that repeat an id, are judged by their own text. An empty table stays
    empty, and so does one met with an empty benchmark as it is. All columns come back as they are.
    """
    found = contamination(docs, frames.table(spark, sf_dir, "benchmark")).filter("contaminated")
    leaks = found.select(F.col("doc_id").alias("_leak_id"), F.col("mark").alias("_leak_mark")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_leak_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_leak_mark"))
    return docs.join(leaks, same, "left_anti")
