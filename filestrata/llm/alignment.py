"""Alignment of two tokenizers' tokens of one text by sparse matrix products.

Each side has an incidence matrix of tokens and bytes, in compressed sparse rows: row i holds a one for every byte of token i.
Row products by Gustavson's method, A times B transposed, have an entry for each pair of tokens that overlap; its value is the
number of bytes they share. Offsets at which tokens of both sides end cut a text into groups. Incidence matrices of tokens and
groups, multiplied alike, have an entry for each pair of tokens that share a group.

A text is cut into segments where both sides surely end a token: before a space, line feed or tab that follows a character other
than white space, if no piece goes on over such a place. Groups and links lie inside segments, so each distinct segment is encoded
and multiplied once, and a text adds up its segments. Products are made for blocks of rows of bounded work, and texts are added up
in blocks of segments, so a long text, or a group of very many tokens, is never expanded at once.

Counts of linked id pairs cover the whole corpus. At most `HEAVY` pairs can have a count of total / `HEAVY` or more; these reach
every task as a broadcast table, and only links of rarer pairs travel to a join.

Texts that are null or empty, and texts whose tokens' bytes differ from the text after a space, have no tokens. Rows come back as
often as they went in, and repeated rows count as often; null ids are rows like others; an empty table gives an empty result;
other columns play no part.
"""
from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import discard, stored
from . import frames

#: Multiplications of one block of row products.
PRODUCTS = 1 << 21
#: Id pairs of the broadcast table.
HEAVY = 1 << 20
#: Text that is aligned at a time.
SLICE = 1 << 20
#: Segments that are encoded as one text.
RUN = 512
#: Segments of a text that are added up at a time, and characters of the segments that a worker keeps, some for each besides its own.
BLOCK, KEPT, EACH = 1 << 17, 12 << 20, 40


class Csr(NamedTuple):
    """Row i has the entries `indptr[i]` to `indptr[i + 1]` of `indices` (columns, rising) and `data`."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    width: int


def incidence(ends: np.ndarray, width: int) -> Csr:
    """Tokens against bytes; token i ends before byte `ends[i]`, where the next one begins."""
    return Csr(np.concatenate(([0], ends)), np.arange(width), np.ones(width, dtype=np.int64), width)


def membership(group: np.ndarray, width: int) -> Csr:
    """Tokens against groups; token i is in `group[i]` alone."""
    return Csr(np.arange(len(group) + 1), group, np.ones(len(group), dtype=np.int64), width)


def transposed(m: Csr) -> Csr:
    rows = np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr))
    order = np.argsort(m.indices, kind="stable")
    indptr = np.concatenate(([0], np.cumsum(np.bincount(m.indices, minlength=m.width))))
    return Csr(indptr, rows[order], m.data[order], len(m.indptr) - 1)


def reach(a: Csr, b: Csr) -> np.ndarray:
    """Multiplications before each row of a's product with b, and in all."""
    return np.concatenate(([0], np.cumsum(np.diff(b.indptr)[a.indices])))[a.indptr]


def products(a: Csr, b: Csr, most: int = PRODUCTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and values of a times b, in order; a block has `most` multiplications at most, or one row of a."""
    before, sizes, start = reach(a, b), np.diff(b.indptr), 0
    while start < len(a.indptr) - 1:
        stop = max(start + 1, int(np.searchsorted(before, before[start] + most, side="right")) - 1)
        entries = slice(a.indptr[start], a.indptr[stop])
        inner = a.indices[entries]
        times = sizes[inner]
        place = np.repeat(b.indptr[inner] - np.cumsum(times) + times, times) + np.arange(times.sum())
        rows = np.repeat(np.repeat(np.arange(start, stop), np.diff(a.indptr[start:stop + 1])), times)
        key = rows * b.width + b.indices[place]
        value = np.repeat(a.data[entries], times) * b.data[place]
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        if len(key):
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            yield key[first] // b.width, key[first] % b.width, np.add.reduceat(value, first)
        start = stop


class ByteSide:
    """A byte-level tokenizer file; special strings are plain text."""

    def __init__(self, path: str):
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path) as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # Bytes of the byte-level alphabet that stand for themselves; the others take 256 and on, in order.
        same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in same}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(same))}
        self.bytes = [b""] * self.library.get_vocab_size()
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(map(byte_of.get, token)) if set(token) <= byte_of.keys() else token.encode()

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]


class PieceSide:
    """A sentencepiece BPE model that puts a space ahead of a text."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(pieces)]
        self.space = self.library.piece_to_id("▁")
        #: White space that no piece has after another character; a space can follow spaces.
        self.cuts = "".join(c for c in " \n\t" if not any(c in p.replace("▁", " ").lstrip(" ") for p in pieces if p != c))

    def ids(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts as they stand. The library puts a space ahead, but makes nothing of nothing."""
        found = self.library.encode([t.removeprefix(" ") for t in texts], out_type=int, num_threads=1)
        return [(ids or [self.space]) if text[:1] == " " else ids[1:] for text, ids in zip(texts, found)]


class _Digits:
    """Decimal ids with a separator each, as bytes, for many ids at once."""

    def __init__(self, size: int):
        width = len(str(size))
        self.text = np.zeros((size, width + 1), dtype=np.uint8)
        for i in range(size):
            for j, digit in enumerate(str(i).encode()):
                self.text[i, j] = digit
        self.length = (self.text > 0).sum(axis=1)
        self.inside = np.arange(width + 1) <= self.length[:, None]

    def joined(self, ids: np.ndarray, separators: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes, and where each id's begin and the last one's end."""
        text = self.text[ids]
        text[np.arange(len(ids)), self.length[ids]] = separators
        return text[self.inside[ids]].tobytes(), np.concatenate(([0], np.cumsum(self.length[ids] + 1)))


class Aligner:
    """Two vocabularies, and what is known of the segments met so far: `facts` has their tokens of both sides, groups, shared pairs
    and links, `pairs` from `first` on the id pairs of their links, and `groups` their groups as text."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteSide(path_a), PieceSide(path_b)
        self.a_size, self.b_size = (np.array(list(map(len, side.bytes))) for side in (self.a, self.b))
        self.digits = _Digits(max(len(self.a_size), len(self.b_size)))
        cuts = self.b.cuts
        self.segments = re.compile(rf"\s*\S+(?:[^\S{cuts}]\s*\S*)*|\s+" if cuts else r"[\s\S]+").findall
        self.forget()

    def forget(self) -> None:
        self.known, self.size, self.groups, self.wrong = {}, 0, [], np.zeros(0, dtype=bool)
        self.facts, self.first, self.pairs = np.zeros((0, 5), dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """The ids of both sides, of texts that start with white space; none where the bytes of a side are not the text."""
        out = []
        for text, a, b in zip(texts, self.a.ids(texts), self.b.ids(texts)):
            same = all(b"".join(map(side.bytes.__getitem__, ids)) == text.encode() for side, ids in ((self.a, a), (self.b, b)))
            out.append((a, b) if same else ([], []))
        return out

    def tokens_of_segments(self, segments: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of all segments in one, and where each segment's begin.

        Segments that end in another character than white space are encoded many at a time, as parts of one text.
        """
        runs, single = [], []
        inner = [s for s in segments if not s[-1:].isspace()] if self.b.cuts else []
        for i in range(0, len(inner), RUN):
            run = inner[i:i + RUN]
            ends, text = np.cumsum([len(s.encode()) for s in run]), "".join(run)
            found = []
            for side, sizes in ((self.a, self.a_size), (self.b, self.b_size)):
                ids = side.ids([text])[0]
                flat = np.array(ids, dtype=np.int64)
                at = np.cumsum(sizes[flat])
                bounds = np.searchsorted(at, ends)
                if b"".join(map(side.bytes.__getitem__, ids)) != text.encode() or (at[bounds] != ends).any():
                    break
                found.append((flat, bounds + 1))
            if len(found) == 2:
                runs.append((run, found))
            else:
                single += run
        single += [s for s in segments if s[-1:].isspace()] if self.b.cuts else segments
        for segment, pair in zip(single, self.tokens(single)):
            runs.append(([segment], [(np.array(ids, dtype=np.int64), np.array([len(ids)])) for ids in pair]))
        segments[:] = [s for run, _ in runs for s in run]
        out = []
        for side in (0, 1):
            sizes = np.concatenate([np.diff(found[side][1], prepend=0) for _, found in runs])
            out.append((np.concatenate([found[side][0] for _, found in runs]), np.concatenate(([0], np.cumsum(sizes)))))
        return out

    def learn(self, segments: list[str]) -> None:
        found = Aligned(self, *self.tokens_of_segments(segments))
        n_groups, n_shared = found.counts()
        of, pairs = found.linked_ids()
        n_links = np.bincount(of, minlength=len(segments))
        n_a, n_b = np.diff(found.a_bounds), np.diff(found.b_bounds)
        self.known.update(zip(segments, range(len(self.groups), len(self.groups) + len(segments))))
        self.size += sum(map(len, segments)) + EACH * len(segments)
        self.groups += found.groups()
        self.wrong = np.append(self.wrong, n_a == 0)
        self.facts = np.concatenate([self.facts, np.stack([n_a, n_b, n_groups, n_links, n_shared], axis=1)])
        self.first = np.append(self.first, self.first[-1] + np.cumsum(n_links))
        self.pairs = np.append(self.pairs, pairs)

    def aligned(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text its sums of `facts` and the digest of its groups; over its distinct id pairs the text, pair and links."""
        words = [self.segments(" " + text) if text else [] for text in texts]
        if self.size > KEPT:
            self.forget()
        missing = list(set().union(*words).difference(self.known))
        if missing:
            self.learn(missing)
        at = [np.fromiter(map(self.known.__getitem__, w), dtype=np.int64, count=len(w)) for w in words]
        at = [np.zeros(0, dtype=np.int64) if self.wrong[x].any() else x for x in at]
        hashes, sums, parts = [hashlib.sha256() for _ in texts], np.zeros((len(texts), 5), dtype=np.int64), []
        for i, start, block in _blocks(at):
            bounds = np.cumsum([0, *map(len, block)])
            joined = np.concatenate(block)
            added = np.concatenate([np.zeros((1, 5), dtype=np.int64), np.cumsum(self.facts[joined], axis=0)])
            sums[i:i + len(block)] += np.diff(added[bounds], axis=0)
            for j, x in enumerate(block):
                if len(x):
                    hashes[i + j].update((b";" if start else b"") + b";".join(map(self.groups.__getitem__, x.tolist())))
            sizes = self.facts[joined, 3]
            place = np.repeat(self.first[joined] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            of = np.repeat(np.repeat(np.arange(i, i + len(block)), np.diff(bounds)), sizes)
            parts.append(_runs(of, self.pairs[place]))
        parts = _runs(*(np.concatenate(x) for x in zip(*parts))) if len(parts) > 1 else parts[0]
        return sums, [h.hexdigest() if len(x) else "" for h, x in zip(hashes, at)], *parts


def _blocks(lists: list[np.ndarray]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Runs of lists of `BLOCK` numbers at most, with the first one's place; a longer list comes in parts, each with its start."""
    i = 0
    while i < len(lists):
        if len(lists[i]) > BLOCK:
            for start in range(0, len(lists[i]), BLOCK):
                yield i, start, [lists[i][start:start + BLOCK]]
            i += 1
            continue
        stop, held = i, 0
        while stop < len(lists) and held + len(lists[stop]) <= BLOCK:
            held += len(lists[stop])
            stop += 1
        yield i, 0, lists[i:stop]
        i = stop


def _runs(of: np.ndarray, pair: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, pair) in order, with how often each is there, or the sums of `n`."""
    if not len(of):
        return of, pair, np.zeros(0, dtype=np.int64)
    width = int(pair.max()) + 1
    key = of * width + pair
    if n is None:
        key.sort()
        n = np.ones(len(key), dtype=np.int64)
    else:
        order = np.argsort(key)
        key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first] // width, key[first] % width, np.add.reduceat(n, first)


class Aligned:
    """Texts one after the other: `a_ids`, `b_ids`, their bytes and groups; text i has the tokens between its bounds."""

    def __init__(self, aligner: Aligner, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]):
        self.aligner = aligner
        (self.a_ids, self.a_bounds), (self.b_ids, self.b_bounds) = a, b
        self.a_ends, self.b_ends = np.cumsum(aligner.a_size[self.a_ids]), np.cumsum(aligner.b_size[self.b_ids])
        self.width = int(self.a_ends[-1]) if len(self.a_ends) else 0
        self.group_ends = np.intersect1d(self.a_ends, self.b_ends, assume_unique=True)
        self.a_group, self.b_group = (np.searchsorted(self.group_ends, ends) for ends in (self.a_ends, self.b_ends))

    def texts_of(self, a_tokens: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.a_bounds, a_tokens, side="right") - 1

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Linked tokens of both sides and the bytes they share."""
        return products(incidence(self.a_ends, self.width), transposed(incidence(self.b_ends, self.width)))

    def shared_groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Tokens of both sides in one group."""
        n = len(self.group_ends)
        return products(membership(self.a_group, n), transposed(membership(self.b_group, n)))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Groups of each text, and its pairs of tokens that share a group, which are counted without being made."""
        first = np.searchsorted(self.group_ends, np.concatenate(([0], self.a_ends))[self.a_bounds], side="right")
        n = len(self.group_ends)
        pairs = reach(membership(self.a_group, n), transposed(membership(self.b_group, n)))
        return np.diff(first), np.diff(pairs[self.a_bounds])

    def groups(self) -> list[bytes]:
        """The groups of each text as decimal ids in order."""
        order = np.argsort(np.concatenate([2 * self.a_group, 2 * self.b_group + 1]), kind="stable")
        group = np.concatenate([self.a_group, self.b_group])[order]
        of_b = order >= len(self.a_ids)
        last = np.append((group[1:] != group[:-1]) | (of_b[1:] != of_b[:-1]), True)[:len(order)]
        separators = np.where(~last, ord(","), np.where(of_b, ord(";"), ord("|"))).astype(np.uint8)
        text, starts = self.aligner.digits.joined(np.concatenate([self.a_ids, self.b_ids])[order], separators)
        bounds = starts[self.a_bounds + self.b_bounds]
        return [text[a:max(a, b - 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def linked_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """The text and the id pair of each link, in order of the texts."""
        size, found = len(self.aligner.b_size), [(rows, columns) for rows, columns, _ in self.overlaps()]
        rows, columns = (np.concatenate([x[i] for x in found] or [np.zeros(0, dtype=np.int64)]) for i in (0, 1))
        return self.texts_of(rows), self.a_ids[rows] * size + self.b_ids[columns]


def _flat(tokens: list[tuple[list[int], list[int]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.array([i for t in tokens for i in t[side]], dtype=np.int64), np.cumsum([0, *(len(t[side]) for t in tokens)])) for side in (0, 1)]


def _aligner(path_a: str, path_b: str) -> Aligner:
    return frames.kept(f"aligner {path_a} {path_b}", lambda: Aligner(path_a, path_b))


def _lists(values: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per text: `doc_id`, counts, digest, and its distinct linked id pairs (`a * size of b's vocabulary + b`) with their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for batch in frames.slices(batches, "text", SLICE):
            sums, digests, of, pair, n = aligner.aligned(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), *map(frames.longs, sums.T), pa.array(digests, pa.string()), _lists(pair, of, batch.num_rows),
                _lists(n, of, batch.num_rows),
            ], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "pairs", "times"])

    return frames.texts(docs).mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, "
             "pairs array<long>, times array<long>")


def links(docs: DataFrame, path_a: str, path_b: str, by: str = "bytes") -> DataFrame:
    """Every link as a row: `doc_id`, the places of both tokens in their text, their ids, and the bytes they share.

    With `by="groups"` the links are pairs of tokens in one group, and `shared` is 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for batch in frames.slices(batches, "text", SLICE):
            texts = batch.column("text").to_pylist()
            tokens = iter(aligner.tokens([" " + text for text in texts if text]))
            found = Aligned(aligner, *_flat([next(tokens) if text else ([], []) for text in texts]))
            for rows, columns, shared in found.overlaps() if by == "bytes" else found.shared_groups():
                of = found.texts_of(rows)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(of)), *map(frames.longs, (
                        rows - found.a_bounds[of], columns - found.b_bounds[of], found.a_ids[rows], found.b_ids[columns], shared)),
                ], ["doc_id", "a", "b", "a_id", "b_id", "shared"])

    return frames.texts(docs).mapInArrow(run, "doc_id long, a long, b long, a_id long, b_id long, shared long")


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """`pair, links, best`: the corpus-wide links of each id pair, and whether no pair of its B id has more.

    Links are summed per task first; what is grouped by B id are counts of pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _runs(*np.zeros((2, 0), dtype=np.int64))
        for batch in batches:
            pair, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            held = _runs(*(np.append(x, y) for x, y in zip(held, (np.zeros_like(pair), pair, n))))
            if len(held[1]) > PRODUCTS:
                yield pa.RecordBatch.from_arrays(list(map(frames.longs, held[1:])), ["pair", "links"])
                held = tuple(x[:0] for x in held)
        yield pa.RecordBatch.from_arrays(list(map(frames.longs, held[1:])), ["pair", "links"])

    counted = aligned.select("pairs", "times").mapInArrow(run, "pair long, links long").groupBy("pair").agg(F.sum("links").alias("links"))
    counted = stored(counted.withColumn("b_id", F.col("pair") % size_b))
    # One row per entry of B's vocabulary at most.
    best = counted.groupBy("b_id").agg(F.max("links").alias("most"))
    out = stored(counted.join(F.broadcast(best), "b_id").select("pair", "links", (F.col("links") == F.col("most")).alias("best")))
    discard(counted)
    return out


def with_counts(aligned: DataFrame, counts: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The rows of `aligned`, which has a key `row`, with `n_best` and `count_sum` over their links."""
    total = counts.agg(F.sum("links")).first()[0] or 0
    least = max(1, -(-total // heavy))  # at most `heavy` pairs have so many links
    table = counts.filter(F.col("links") >= least).orderBy("pair").withColumn("best", F.col("best").cast("long")).toArrow()
    held = aligned.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "links", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_links, known_best = held.value
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            sizes = np.diff(batch.column("pairs").offsets.to_numpy())
            bounds, of = np.concatenate(([0], np.cumsum(sizes))), np.repeat(np.arange(len(sizes)), sizes)
            at = np.searchsorted(known, pairs)
            met = np.append(known, -1)[at] == pairs
            sums = [np.diff(np.concatenate(([0], np.cumsum(times * np.append(x, 0)[np.where(met, at, len(known))])))[bounds])
                    for x in (known_best, known_links)]
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), *map(frames.longs, sums), _lists(pairs[~met], of[~met], len(sizes)),
                _lists(times[~met], of[~met], len(sizes)), *(batch.column(c) for c in plain),
            ], ["row", "n_best", "count_sum", "pairs", "times", *plain])

    plain = [c for c in aligned.columns if c not in ("row", "pairs", "times")]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name in plain)
    out = aligned.select("row", "pairs", "times", *plain).mapInArrow(
        run, f"row long, n_best long, count_sum long, pairs array<long>, times array<long>, {types}")
    if least == 1:
        return out.drop("row", "pairs", "times")
    out = stored(out)
    rare = out.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
    more = (
        rare.join(counts.filter(F.col("links") < least), "pair").groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("links")).alias("more_sum"))
    )
    both = out.join(more, "row", "left")
    return both.select(*plain, *[(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("n_best", "more_best"), ("count_sum", "more_sum"))])


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, heavy: int = HEAVY) -> DataFrame:
    """The alignment of each text, with corpus-wide counts of its links' id pairs."""
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    aligned = stored(alignments(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()))
    return with_counts(aligned, pair_counts(aligned, size_b), heavy)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of a byte-level and a sentencepiece vocabulary line up in every document."""
    path = public_tokenizers.path
    return aligned_documents(frames.table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")
