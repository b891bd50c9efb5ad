"""Quality rules as weak supervision: each rule votes good, bad or abstains, and their accuracies are learnt.

No rule decides alone. The rules' votes on all documents are counted by pattern (at most three to the
power of the number of rules), expectation-maximisation estimates from these counts how often documents
are good, and how often each rule is right on good and on bad ones where it votes, without any labels. The
posterior probability that a document is good, given all its votes, takes the place of passing every rule.

A null text has no words: every rule that needs words abstains, and the document fails the base check.
Rows come back as often as they went in; an empty table gives an empty result.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import frozen
from . import frames
from .words import Words, window_hashes

# Frequent function words of the languages of the corpus.
STOP_WORDS = """the of and to in a is that for it was on are as with be by this an or from at
der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als
de la le et les des en un du une que est pour qui dans par sur au pas avec
de la que el en y a los se del las un por con una su para es lo como""".split()

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower",
          "n_shouts", "n_stops", "n_ends", "n_digits", "n_echoes")


def _marked(words: Words, mask: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has."""
    return np.diff(np.concatenate(([0], np.cumsum(mask)))[words.offset])


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that repeat an earlier one."""
    if b"\n" not in text:
        return int(bool(text.strip(b" \t\n\v\f\r"))), 0
    with_word = [line for line in text.split(b"\n") if line.strip(b" \t\n\v\f\r")]
    return len(with_word), len(with_word) - len(set(with_word))


def _repeated(hashes: np.ndarray, size: int = 5) -> int:
    """Words that lie in a window of `size` words found twice or more."""
    windows = window_hashes(hashes, size)
    if len(windows) < 2:
        return 0
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[place] > 1)
    if not len(twice):
        return 0
    change = np.zeros(len(hashes) + 1, dtype=np.int64)
    change[twice] += 1
    change[twice + size] -= 1
    return int(np.count_nonzero(np.cumsum(change)))


def text_stats(docs: DataFrame) -> DataFrame:
    """`doc_id` and the counts of `_STATS` over each whole text."""
    stops = np.unique(Words([w.encode() for s in STOP_WORDS for w in (s, s.capitalize())]).hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames.slices(batches, "text"):
            texts = frames.raw(batch.column("text"))
            words = Words(texts)
            codes = np.frombuffer(words.joined, dtype=np.uint8)
            change = np.zeros(len(codes) + 1, dtype=np.int8)
            change[words.begin] += 1
            change[words.end] -= 1
            inside = np.cumsum(change[:-1], dtype=np.int8).view(bool)
            is_stop = stops[np.minimum(np.searchsorted(stops, words.hashes), len(stops) - 1)] == words.hashes
            last = codes[words.end - 1]
            per_word = np.concatenate(([[0], [0]], [np.cumsum(is_stop), np.cumsum(np.isin(last, list(b".!?")))]), axis=1)
            n_stops, n_ends = np.diff(per_word[:, words.first], axis=1)
            lines = [_lines(t) for t in texts]
            first = words.first
            echo = words.hashes[1:] == words.hashes[:-1]
            echoes = [np.count_nonzero(echo[first[i]:max(first[i], first[i + 1] - 1)]) for i in range(len(texts))]
            columns = [
                words.counts(), _marked(words, inside & ((codes & 0xC0) != 0x80)), _marked(words, _SYMBOLS[codes]),
                [d for _, d in lines], [_repeated(words.hashes[first[i]:first[i + 1]]) for i in range(len(texts))],
                [n for n, _ in lines], _marked(words, (codes >= 65) & (codes <= 90)), _marked(words, (codes >= 97) & (codes <= 122)),
                _marked(words, codes == ord("!")), n_stops, n_ends, _marked(words, (codes >= 48) & (codes <= 57)), echoes,
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(frames.longs, columns)], ["doc_id", *_STATS])

    return frames.texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in _STATS))


@dataclass(frozen=True)
class Rule:
    """Votes bad where `bad` holds, else good where `good` holds, else abstains."""

    name: str
    bad: str
    good: str


#: Each compares counts of one text; all are conditions over the columns of `text_stats`.
RULES = (
    Rule("length", "n_words < 20", "n_words >= 50"),
    Rule("word_length", "n_words >= 5 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words)",
         "n_words >= 5 AND word_chars >= 3 * n_words AND word_chars <= 10 * n_words"),
    Rule("symbols", "n_words > 0 AND 10 * n_symbols > n_words", "n_words > 0 AND 50 * n_symbols <= n_words"),
    Rule("duplicate_lines", "n_lines >= 2 AND 10 * n_dup_lines > 3 * n_lines", "n_lines >= 2 AND n_dup_lines = 0"),
    Rule("repeats", "n_words >= 10 AND 5 * n_repeat_words > n_words", "n_words >= 10 AND 20 * n_repeat_words <= n_words"),
    Rule("capitals", "n_upper + n_lower >= 20 AND 2 * n_upper > n_lower", "n_upper + n_lower >= 20 AND 10 * n_upper <= n_lower"),
    Rule("shouts", "n_words >= 5 AND 10 * n_shouts > n_words", "n_words >= 5 AND 50 * n_shouts <= n_words"),
    Rule("function_words", "n_words >= 20 AND 50 * n_stops < n_words", "n_words >= 20 AND 10 * n_stops >= n_words"),
    Rule("digits", "n_words >= 5 AND 5 * n_digits > word_chars", "n_words >= 5 AND 50 * n_digits <= word_chars"),
    Rule("echoes", "n_words >= 5 AND 5 * n_echoes > n_words", "n_words >= 5 AND 50 * n_echoes <= n_words"),
)


def vote(rule: Rule) -> Column:
    """-1 for bad, 1 for good, 0 for abstaining."""
    return F.when(F.expr(rule.bad), -1).when(F.expr(rule.good), 1).otherwise(0)


@dataclass(frozen=True)
class Accuracies:
    """What expectation-maximisation found: the share of good documents and each rule's hit rates."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 200) -> Accuracies:
    """Expectation-maximisation over vote patterns with their counts; starts from the share of good votes.

    Every rate has a prior of a few pseudo-votes for being right more often than not, which also settles rules that
    always abstain and empty tables.
    """
    if not patterns:
        return Accuracies(0.5, (0.75,) * n_rules, (0.75,) * n_rules)
    votes = np.array([p for p, _ in patterns], dtype=np.int8)
    weight = np.array([n for _, n in patterns], dtype=float)
    good, bad = votes == 1, votes == -1
    posterior = (good.sum(axis=1) + 1) / (good.sum(axis=1) + 2 * bad.sum(axis=1) + 2)
    found = Accuracies(0.5, (), ())
    for _ in range(rounds):
        w_good, w_bad = weight * posterior, weight * (1 - posterior)
        prior = (w_good.sum() + 1) / (weight.sum() + 2)
        on_good = (w_good @ good + 3) / (w_good @ (good | bad) + 4)
        on_bad = (w_bad @ bad + 3) / (w_bad @ (good | bad) + 4)
        found = Accuracies(float(prior), tuple(map(float, on_good)), tuple(map(float, on_bad)))
        odds = math.log(prior / (1 - prior)) + good @ np.log(on_good / (1 - on_bad)) + bad @ np.log((1 - on_good) / on_bad)
        new = 1 / (1 + np.exp(-odds))
        if np.max(np.abs(new - posterior)) < 1e-9:
            break
        posterior = new
    return found


def posterior(found: Accuracies, rules: tuple[Rule, ...] = RULES) -> Column:
    """The probability of being good, as an expression over vote columns named `vote_<rule>`."""
    odds = F.lit(math.log(found.prior / (1 - found.prior)))
    for rule, a, b in zip(rules, found.on_good, found.on_bad):
        v = F.col(f"vote_{rule.name}")
        odds = odds + F.when(v == 1, math.log(a / (1 - b))).when(v == -1, math.log((1 - a) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts, votes and posterior `quality` of each text."""
    votes = [f"vote_{rule.name}" for rule in rules]
    voted = frozen(text_stats(docs).select("*", *[vote(rule).alias(name) for rule, name in zip(rules, votes)]))
    # At most 3 ** len(rules) patterns, whatever the number of documents.
    patterns = [(tuple(row[:-1]), row[-1]) for row in sorted(voted.groupBy(*votes).count().collect())]
    return voted.withColumn("quality", posterior(estimate(patterns, len(rules)), rules))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base check and verdict of every document: kept where good is likelier than bad."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged(frames.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("quality") >= 0.5)).alias("kept"), "quality")


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base check of every document, without the rules' verdict."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return text_stats(frames.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


BASE_SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
  FROM texts WHERE len(w) >= 5
), twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, i + unnest(range(5)) AS place FROM twice) GROUP BY doc_id
), counted AS (
  SELECT x.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(c.n, 0) AS n_repeat_words
  FROM texts x LEFT JOIN covered c ON c.doc_id = x.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
"""
