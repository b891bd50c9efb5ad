"""Language identification by words first, and by ever shorter character n-grams for words that were not met.

A word is a run of letters and marks with a letter in it, lower-cased letter by letter. Of each language the model holds the
words, and the n-grams of each order inside a space on both sides of its words, whose share of the language's words, or n-grams,
reaches a floor. The floor is languages / `POSTINGS`, so all languages together hold at most `POSTINGS` entries for words and for
each order, whatever the size of the corpus. Counts cover all training texts.

A word that some language knows scores the log share in each language, and half the floor where it is not known. Another word
is looked at through its n-grams of the longest order; if none of them is known, of the next shorter one. It scores the mean over
its known n-grams. A word without any known n-gram tells nothing. A text's scores are its words' sums; the language with the
largest wins, among equals the first by name, and `score` is its share of the likelihoods, with the same odds for all at first.

A null text, a text without a letter, and every text where nothing was learnt are `und` with score 0; texts whose words tell
nothing get the first language by name. Rows without text or language teach nothing. A null id counts as an empty one when rows
are held out. Rows come back as often as they went in; an empty table gives an empty result; other columns play no part.
"""
from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import discard, stored
from . import frames
from .words import mixed

#: Orders of n-grams, in the order they are tried.
ORDERS = (5, 4, 3, 2, 1)
#: Entries of all languages together, for words and for each order.
POSTINGS = 1 << 20
#: Text that is looked at a time.
SLICE = 1 << 20

_RANDOM = np.random.default_rng(20240311)
_FACTOR = _RANDOM.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, whether it is a letter or a mark, and its lower case."""
    letter = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)
    inside = letter | np.fromiter((unicodedata.category(chr(i))[0] == "M" for i in range(sys.maxunicode + 1)), dtype=bool, count=len(letter))
    lower = np.arange(len(letter), dtype=np.uint32)
    for i in np.flatnonzero(letter):
        low = chr(i).lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return letter, inside, lower


class Found(NamedTuple):
    """The words of some texts: each distinct one's hash, code points and place in `codes`; the words of each text by number."""

    hashes: np.ndarray
    codes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    word: np.ndarray
    text: np.ndarray


def pieces(texts: list[str], limit: int = SLICE) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Runs of texts of `limit` characters at most, each with its number; longer texts come in parts that end at a space."""
    of, held, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            stop = len(text)
            if stop - at > limit:
                stop = text.rfind(" ", at, at + limit) + 1 or text.find(" ", at + limit) + 1 or len(text)
            if held and size + stop - at > limit:
                yield np.array(of), held
                of, held, size = [], [], 0
            of.append(i)
            held.append(text[at:stop])
            size += stop - at
            at = stop
    if held:
        yield np.array(of), held


def words_of(texts: list[str]) -> Found:
    letter, inside, lower = frames.kept("letters", _tables)
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), dtype=np.uint32)
    mask = inside[codes]
    change = np.diff(np.concatenate(([False], mask)).view(np.int8), append=0)
    begin, end = np.flatnonzero(change[:-1] == 1), np.flatnonzero(change[:-1] == -1)
    if len(begin):
        with_letter = np.add.reduceat(letter[codes] & mask, np.stack([begin, end], axis=1).ravel(), dtype=np.int64)[::2] > 0
        begin, end = begin[with_letter], end[with_letter]
    low = lower[codes]
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, side="right")
    hashes = _spans(low, begin, end)
    known, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    return Found(known, low, begin[first], end[first], word, text)


def _spans(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of code points, its length included."""
    sizes = end - begin
    if not len(sizes):
        return np.zeros(0, dtype=np.uint64)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    letters = codes[np.repeat(begin, sizes) + place].astype(np.uint64) + np.uint64(1)
    factor = _FACTOR[place & 4095] * (2 * (place >> 12) + 1).astype(np.uint64)
    return mixed(np.add.reduceat(mixed(letters) * factor, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64) * _SALT[0])


def grams(found: Found, which: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the n-grams of some distinct words with a space on both sides, and the place in `which` of each one's word."""
    sizes = found.end[which] - found.begin[which]
    padded = sizes + 2
    starts = np.cumsum(padded) - padded
    of = np.repeat(np.arange(len(which)), padded)
    place = np.arange(padded.sum()) - starts[of]
    inner = (place > 0) & (place <= sizes[of])
    letters = np.full(len(of), 32, dtype=np.uint64)
    letters[inner] = found.codes[found.begin[which][of[inner]] + place[inner] - 1]
    letters = mixed(letters + np.uint64(1))
    at = np.flatnonzero(place + order <= padded[of])
    total = np.full(len(at), _SALT[order], dtype=np.uint64)
    for j in range(order):
        total += letters[at + j] * _FACTOR[j]
    if order == 1:  # a space is in every word and tells nothing
        keep = inner[at]
        at, total = at[keep], total[keep]
    return mixed(total), of[at]


def _counted(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    hashes = hashes[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    return hashes[first], np.add.reduceat(n[order], first)


def counts(labelled: DataFrame) -> DataFrame:
    """`lang, kind, hash, n`: how often each language's texts have each word (`kind` 0) and n-gram (its order), by hash.

    Rows whose `hash` is null hold the totals. Each slice of texts is summed before anything moves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames.slices(batches, "text", SLICE):
            langs, texts = np.array(batch.column("lang").to_pylist(), dtype=object), batch.column("text").to_pylist()
            for lang, held in ((x, held) for x in sorted(set(langs)) for _, held in pieces([texts[i] for i in np.flatnonzero(langs == x)])):
                found = words_of(held)
                times = np.bincount(found.word, minlength=len(found.hashes))
                every = np.arange(len(found.hashes))
                for kind in (0, *ORDERS):
                    hashes, n = found.hashes, times
                    if kind:
                        hashes, of = grams(found, every, kind)
                        n = times[of]
                    if not len(hashes):
                        continue
                    hashes, n = _counted(hashes, n)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * (len(n) + 1)), pa.array(np.full(len(n) + 1, kind, dtype=np.int32)),
                        pa.concat_arrays([pa.array(hashes.view(np.int64)), pa.array([None], pa.int64())]), frames.longs(np.append(n, n.sum())),
                    ], ["lang", "kind", "hash", "n"])

    pairs = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    return pairs.mapInArrow(run, "lang string, kind int, hash long, n long").groupBy("lang", "kind", "hash").agg(F.sum("n").alias("n"))


class Model(NamedTuple):
    """For words and each order: `floors` of a log share, and for each language its sorted hashes and their log shares."""

    langs: list[str]
    floor: float
    known: dict[int, list[tuple[np.ndarray, np.ndarray]]]


def fitted(labelled: DataFrame, postings: int = POSTINGS) -> Model:
    """The model of the languages of the rows (`text`, `lang`); it has `postings` entries a kind at most."""
    # Shares are judged where the counts are, so only entries above the floor come to the driver.
    table = stored(counts(labelled))
    totals = table.filter("hash IS NULL").select("lang", "kind", F.col("n").alias("total"))
    langs = sorted(row["lang"] for row in totals.filter("kind = 0").select("lang").collect())
    floor = max(len(langs), 1) / postings
    share = F.col("n") / F.col("total")
    kept = table.filter("hash IS NOT NULL").join(F.broadcast(totals), ["lang", "kind"]).filter(share >= floor)
    rows = kept.select("lang", "kind", "hash", share.alias("share")).toArrow()
    discard(table)
    lang, kind, hashes, shares = (rows[c].to_numpy() for c in ("lang", "kind", "hash", "share"))
    known: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for k in (0, *ORDERS):
        known[k] = []
        for name in langs:
            at = np.flatnonzero((lang == name) & (kind == k))
            at = at[np.argsort(hashes[at].astype(np.int64).view(np.uint64))]
            known[k].append((hashes[at].astype(np.int64).view(np.uint64), np.log(shares[at].astype(float))))
    return Model(langs, float(np.log(floor / 2)), known)


def _looked_up(tables: list[tuple[np.ndarray, np.ndarray]], floor: float, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log share of each hash in each language, and whether any language knows it."""
    out, met = np.full((len(tables), len(hashes)), floor), np.zeros(len(hashes), dtype=bool)
    for row, (known, logs) in zip(out, tables):
        at = np.searchsorted(known, hashes)
        same = at < len(known)
        same[same] = known[at[same]] == hashes[same]
        row[same] = logs[at[same]]
        met |= same
    return out, met


def word_scores(model: Model, found: Found) -> np.ndarray:
    """The log score of each distinct word in each language; zero everywhere for words that tell nothing."""
    scores, met = _looked_up(model.known[0], model.floor, found.hashes)
    left = np.flatnonzero(~met)
    for order in ORDERS:
        if not len(left):
            break
        hashes, of = grams(found, left, order)
        logs, met = _looked_up(model.known[order], model.floor, hashes)
        n = np.bincount(of[met], minlength=len(left))
        done = n > 0
        for row, values in zip(scores, logs):
            row[left[done]] = np.bincount(of[met], weights=values[met], minlength=len(left))[done] / n[done]
        left = left[~done]
    scores[:, left] = 0.0
    return scores


def judged(model: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    n, sums = np.zeros(len(texts), dtype=np.int64), np.zeros((len(model.langs), len(texts)))
    if not model.langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    for of, held in pieces(texts):
        found = words_of(held)
        text = of[found.text]
        n += np.bincount(text, minlength=len(texts))
        for total, row in zip(sums, word_scores(model, found)):
            total += np.bincount(text, weights=row[found.word], minlength=len(texts))
    best = sums.argmax(axis=0)
    score = 1 / np.exp(sums - sums.max(axis=0)).sum(axis=0)
    return ([model.langs[b] if k else "und" for b, k in zip(best, n)], [float(s) if k else 0.0 for s, k in zip(score, n)])


def identified(docs: DataFrame, model: Model, *more: Column) -> DataFrame:
    """`doc_id, lang_pred, score` of each text, and further columns of `docs`."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))
    extra = [c for c in docs.select(*more).schema] if more else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames.slices(batches, "text", SLICE):
            langs, scores = judged(Model(*held.value), batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(batch.column(f.name) for f in extra), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", *(f.name for f in extra), "lang_pred", "score"])

    schema = ", ".join(["doc_id long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in extra), "lang_pred string", "score double"])
    return frames.texts(docs, *more).mapInArrow(run, schema)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the documents that are not held out."""
    docs = frames.table(spark, sf_dir, "documents")
    held_out = frames.residue("doc_id", 3) == 1
    return identified(docs, fitted(docs.filter(~held_out)), held_out.alias("held_out"))
