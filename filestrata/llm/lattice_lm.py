"""Language-model scores of whole texts by the marginal over all segmentations of their words.

The pieces are an existing vocabulary, and its scores, as ranks of a Zipf law, give the first probabilities.
Expectation-maximisation over the distinct words of the training texts, with their counts, adapts them to the corpus. A
text's words are independent given the pieces, as a piece begins a word exactly if it carries the mark of a beginning;
a text is its words and one end. Words met in training are pieces as well: the edge from a word's beginning to its end has
its count less an absolute discount, and what the discounts leave goes to the lattice of the vocabulary. So a text's
probability sums over all segmentations into both. The base score is add-one smoothing of whole-word counts.

Counts of words are one row per distinct word, spread over the cluster. Common words, at most `COMMON` of them, are looked up
in a table that every task holds; the rest of a text's words meet their counts by a join on their hash, at which no word has
more than a bounded share of the rows. The texts themselves are not shuffled.

Null and empty texts have the end as their only token. Without training texts all counts are zero and the vocabulary's own
probabilities hold. Rows come back as often as they went in.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import frozen
from . import frames
from .lattice import BEGIN, Lattice
from .words import Words, mixed

#: Words that every task may hold the counts of, at most.
COMMON = 200_000
ROUNDS = 2
_SLICE = 7 << 20


def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """The pieces that can be part of a word, and first log probabilities of them and of a byte, from their ranks."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    used = [i for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and BEGIN not in model.id_to_piece(i)[1:]]
    scores = np.array([model.get_score(i) for i in used])
    weights = np.append(1 / (10.0 + np.abs(scores)), 1e-6)
    return [model.id_to_piece(i) for i in used], np.log(weights / weights.sum())


def _lowered(words: Words, i: int) -> str:
    return words.word(i).lower().decode()


def word_counts(docs: DataFrame, training: Column) -> DataFrame:
    """`hash, word, c`: how often each lower-cased word occurs in the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames.slices(batches, "text", _SLICE):
            words = Words(frames.raw(batch.column("text")), lower=True)
            hashes, first, counts = np.unique(words.hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(hashes.view(np.int64)), pa.array([_lowered(words, i) for i in first], pa.string()), frames.longs(counts),
            ], ["hash", "word", "c"])

    # Equal hashes are equal words, so that the shuffle's key is a number.
    found = frames.texts(docs.filter(training)).mapInArrow(run, "hash long, word string, c long")
    return found.groupBy("hash", "word").agg(F.sum("c").alias("c"))


def adapted(counts: DataFrame, pieces: list[str], log_p: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces after expectation-maximisation over the counted words."""
    first = np.exp(log_p)
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast((pieces, log_p))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, current = shared.value
            lattice = frames.kept(f"lattice {hash(tuple(names))}", lambda: Lattice(names))
            total = np.zeros(lattice.size)
            words, times = [], []
            for batch in batches:
                words += batch.column("word").to_pylist()
                times.append(batch.column("c").to_numpy())
                if len(words) >= 100_000:
                    total += lattice.log_probabilities(words, current, np.concatenate(times).astype(float))[1]
                    words, times = [], []
            if words:
                total += lattice.log_probabilities(words, current, np.concatenate(times).astype(float))[1]
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([frames.longs(met), pa.array(total[met])], ["piece", "n"])

        # One row for each piece of the vocabulary at most.
        sums = counts.select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        expected = np.zeros(len(pieces) + 1)
        for row in sums:
            expected[row["piece"]] = row["n"]
        # The vocabulary's own probabilities count as one more text, so that no piece becomes impossible.
        smooth = 0.001 * expected.sum() + 1
        weights = expected + smooth * first
        log_p = np.log(weights / weights.sum())
    return log_p


def lm_scores(docs: DataFrame, training: Column, path: str, rounds: int = ROUNDS) -> DataFrame:
    """`doc_id, n_tokens, n_known, train_tokens, base_score, score` of each text, learnt where `training` holds."""
    pieces, log_p = vocabulary(path)
    counts = frozen(word_counts(docs, training))
    n_words, n_distinct, once, twice = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    ends = docs.filter(training).count()
    total, distinct = n_words + ends, n_distinct + (ends > 0)
    if n_words:
        log_p = adapted(counts, pieces, log_p, rounds)
    p_end = (ends + 1) / (total + 2)
    discount = (once + 1) / (once + 2 * twice + 2)
    # Of a word's probability, `of_count` times its discounted count, and `of_lattice` times that of the vocabulary's lattice.
    of_count = (1 - p_end) / max(1, n_words)
    of_lattice = of_count * discount * n_distinct if n_words else 1 - p_end
    # The least count at which at most COMMON words remain; counts are binned by powers, so this is a small table.
    by_power = sorted(counts.groupBy(F.floor(4 * F.log2("c")).alias("p")).count().collect(), reverse=True)
    common, limit = 0, None
    for power, n in by_power:
        if common + n > COMMON:
            break
        common, limit = common + n, power
    at_least = F.floor(4 * F.log2("c")) >= (limit if limit is not None else 1 << 30)
    table = sorted((row["hash"] & (1 << 64) - 1, row["c"]) for row in counts.filter(at_least).select("hash", "c").collect())
    known = np.array([h for h, _ in table] or [0], dtype=np.uint64), np.array([c for _, c in table] or [-1], dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((pieces, log_p, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, current, (hashes, count_of) = shared.value
        lattice = frames.kept(f"lattice {hash(tuple(names))}", lambda: Lattice(names))
        next_row = TaskContext.get().partitionId() << 33
        for batch in frames.slices(batches, "text", _SLICE):
            words = Words(frames.raw(batch.column("text")), lower=True)
            distinct_hashes, first, place = np.unique(words.hashes, return_index=True, return_inverse=True)
            log_word, _ = lattice.log_probabilities([_lowered(words, i) for i in first], current)
            at = np.minimum(np.searchsorted(hashes, distinct_hashes), len(hashes) - 1)
            c = np.where(hashes[at] == distinct_hashes, count_of[at], -1)
            with_count = np.log10(np.maximum(c - discount, 1 - discount) * of_count + of_lattice * np.exp(log_word))
            sums = np.stack([np.where(c >= 0, with_count, 0)[place], np.where(c >= 0, np.log10(np.maximum(c, 0) + 1.0), 0)[place], (c > 0)[place]])
            sums = np.concatenate((np.zeros((3, 1)), np.cumsum(sums, axis=1)), axis=1)
            score, base, n_known = np.diff(sums[:, words.first], axis=1)
            n, n_tokens = batch.num_rows, words.counts()
            rows = next_row + np.arange(n)
            next_row += n
            yield _rows(rows, batch.column("doc_id"), mixed(rows.astype(np.uint64)).view(np.int64), np.zeros(n, dtype=np.int64), n_tokens + 1,
                        n_known + (ends > 0), base + math.log10(ends + 1), score + math.log10(p_end))
            doc = np.repeat(np.arange(n), n_tokens)
            rare = np.flatnonzero(c[place] < 0)
            pair, times = np.unique(doc[rare] * len(distinct_hashes) + place[rare], return_counts=True)
            owner, word = pair // max(1, len(distinct_hashes)), pair % max(1, len(distinct_hashes))
            for a in range(0, len(pair), 100_000):
                part = slice(a, a + 100_000)
                none = np.zeros(len(pair[part]))
                yield _rows(rows[owner[part]], pa.nulls(len(none), pa.int64()), distinct_hashes[word[part]].view(np.int64), times[part],
                            none, none, none, log_word[word[part]])

    found = frames.texts(docs).mapInArrow(
        run, "row long, doc_id long, hash long, times long, n_tokens long, n_known long, base double, score double")
    # The row of a text itself has no times, and a hash of its row number so that it lands anywhere. A word's row has
    # the logarithm of its lattice as its score.
    joined = found.join(counts.select("hash", "c"), "hash", "left")
    count = F.when(F.col("times") > 0, F.coalesce("c", F.lit(0))).otherwise(0)
    # A word without a count has its lattice alone and stays a logarithm, as long words' probabilities are below any double.
    from_lattice = (F.col("score") + math.log(of_lattice)) / math.log(10)
    of_word = F.when(count > 0, F.log10((count - discount) * of_count + of_lattice * F.exp("score"))).otherwise(from_lattice)
    summed = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(count > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.col("times") * F.log10(count + 1.0)).alias("base"),
        F.sum(F.when(F.col("times") > 0, F.col("times") * of_word).otherwise(F.col("score"))).alias("score"))
    return summed.select(
        "doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"), "score")


def _rows(row, doc_id, hashes, times, n_tokens, n_known, base, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [frames.longs(row), doc_id, pa.array(hashes), frames.longs(times), frames.longs(n_tokens), frames.longs(n_known),
         pa.array(base), pa.array(score)],
        ["row", "doc_id", "hash", "times", "n_tokens", "n_known", "base", "score"])


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learnt without the held-out seventh."""
    held_out = frames.residue("doc_id", 7) == 2
    scored = lm_scores(frames.table(spark, sf_dir, "documents"), ~held_out, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
