"""Toxicity by multiple-instance learning: sentence scores, combined by a noisy-or, learnt from document labels.

A document is a bag of sentences. A sentence's evidence are its words and their beginnings, so that inflected forms
of a stem count together; its probability of offending is a logistic function of the evidence, and zero without
any. A document is clean if no sentence offends and a small leak, which stands for labels that
the words don't explain, doesn't either: P = 1 - (1 - leak) * prod(1 - p). Training sees document labels only;
the sentence scores it arrives at then locate the offending sentences.

Evidence is chosen, and the model is fitted, on a bounded sample of labelled documents (`SAMPLE`), the smallest by a
hash of their id; every text is scored whole. Null and empty texts have no evidence and get the leak. Without
labels, or with labels of one kind only, there is no evidence and the score is the (smoothed) share of toxic labels.
Repeated ids in the labels count once, as toxic if any row says so. Rows come back as often as they went in.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import frames

#: Labelled documents to learn from, at most.
SAMPLE = 8_000
#: Pieces of evidence that a model holds, at most.
EVIDENCE = 5_000
THRESHOLD = 0.3
_BEGINNINGS = (3, 4, 5, 6)
_CACHED = 400_000

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def evidence_of(word: str) -> list[str]:
    """The word itself, and its beginnings marked by a hyphen."""
    return [word, *(f"{word[:n]}-" for n in _BEGINNINGS if len(word) > n)]


@dataclass(frozen=True)
class Model:
    leak: float
    bias: float
    weights: dict[str, float] = field(default_factory=dict)


class Scorer:
    """Scores texts; keeps the summed weight of each word that it has met, None for a word without evidence."""

    def __init__(self, model: Model):
        self.model = model
        self.cache: dict[str, float | None] = {}

    def weight(self, word: str) -> float | None:
        found = [self.model.weights[e] for e in evidence_of(word) if e in self.model.weights]
        return math.fsum(found) if found else None

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and (start, end, probability) of each sentence with evidence."""
        lowered = text.lower()
        words = set(_WORD.findall(lowered))
        if len(self.cache) > _CACHED:
            self.cache.clear()
        for word in words.difference(self.cache):
            self.cache[word] = self.weight(word)
        active = {w: self.cache[w] for w in words if self.cache[w] is not None}
        clean, found = 1 - self.model.leak, []
        if active:
            same_length = len(lowered) == len(text)
            for sentence in _SENTENCE.finditer(text if same_length else lowered):
                weights = [active[w] for w in set(_WORD.findall(sentence.group().lower())) if w in active]
                if weights:
                    p = 1 / (1 + math.exp(-max(-700.0, min(700.0, self.model.bias + math.fsum(weights)))))
                    clean *= 1 - p
                    found.append((sentence.start(), sentence.end(), p))
        return 1 - clean, found


def fitted(bags: list[tuple[int, list[list[int]]]], names: list[str], rounds: int = 300) -> Model:
    """Maximum likelihood of the document labels under the leaky noisy-or, with a small ridge, by Adam."""
    labels = np.array([label for label, _ in bags], dtype=float)
    base = (labels.sum() + 1) / (len(labels) + 2)
    if not names or labels.min(initial=1) == labels.max(initial=0):
        return Model(float(base), -4.0)
    doc = np.array([d for d, (_, bag) in enumerate(bags) for _ in bag], dtype=np.int64)
    sentence = np.array([s for s, sent in enumerate(x for _, bag in bags for x in bag) for _ in sent], dtype=np.int64)
    piece = np.array([i for _, bag in bags for sent in bag for i in sent], dtype=np.int64)
    x = np.zeros(len(names) + 2)  # weights, bias, logit of the leak
    x[-2], x[-1] = -4.0, -4.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        z = np.clip(x[-2] + np.bincount(sentence, x[piece], len(doc)), -40, 40)
        leak = 1 / (1 + math.exp(-x[-1]))
        log_clean = math.log1p(-leak) - np.bincount(doc, np.logaddexp(0, z), len(labels))
        clean = np.minimum(np.exp(log_clean), 1 - 1e-9)
        by_doc = np.where(labels == 1, -clean / (1 - clean), 1.0) / len(labels)
        by_z = by_doc[doc] / (1 + np.exp(-z))
        gradient = np.concatenate((np.bincount(piece, by_z[sentence], len(names)) + 1e-4 * x[:-2], [by_z.sum()], [by_doc.sum() * leak]))
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Model(1 / (1 + math.exp(-x[-1])), float(x[-2]), {n: float(w) for n, w in zip(names, x) if abs(w) > 1e-3})


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> Model:
    """The model learnt from `labels` (doc_id, toxic) of documents whose `doc_id` is `usable`."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    if usable is not None:
        known = known.filter(usable)
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` rows of two numbers.
    bags = frames.texts(docs).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    sizes = dict(bags.groupBy("toxic").count().collect())
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = (Counter(), Counter())
        for batch in frames.slices(batches, "text"):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                met[label].update({e for w in set(_WORD.findall(text.lower())) for e in evidence_of(w)})
            if len(met[0]) + len(met[1]) > 500_000:
                yield rows(met)
                met = (Counter(), Counter())
        yield rows(met)

    def rows(met: tuple[Counter, Counter]) -> pa.RecordBatch:
        names = list(met[0] | met[1])
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(frames.longs([c[n] for n in names]) for c in met)], ["piece", "clean", "toxic"])

    lift = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    counts = bags.mapInArrow(count, "piece string, clean long, toxic long").groupBy("piece").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    names = [row["piece"] for row in counts.filter("toxic >= 3").select("piece", "toxic", lift.alias("lift"))
             .filter(F.col("lift") > math.log(4)).orderBy((F.col("toxic") * F.col("lift")).desc(), "piece").limit(EVIDENCE).collect()]
    place = {name: i for i, name in enumerate(names)}

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames.slices(batches, "text"):
            found = []
            for text in batch.column("text").to_pylist():
                sentences = ({place[e] for w in set(_WORD.findall(s)) for e in evidence_of(w) if e in place}
                             for s in _SENTENCE.findall(text.lower()))
                found.append([sorted(s) for s in sentences if s])
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.list_(pa.int32())))], ["toxic", "bag"])

    # At most `sample` rows, each with the evidence of its sentences only.
    seen = bags.mapInArrow(evidence, "toxic int, bag array<array<int>>").collect()
    return fitted(sorted((row["toxic"], row["bag"]) for row in seen), names)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id, score, sentences` of each text; sentences are (start, end, score) in characters, in order."""
    shared = frames.shared(docs.sparkSession, "toxicity", model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared())
        for batch in frames.slices(batches, "text"):
            found = [scorer.score(text) for text in batch.column("text").to_pylist()]
            spans = pa.array([[{"start": a, "end": b, "score": p} for a, b, p in spans] for _, spans in found],
                             pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([p for p, _ in found], pa.float64()), spans], ["doc_id", "score", "sentences"])

    return frames.texts(docs).mapInArrow(run, "doc_id long, score double, sentences array<struct<start:int,end:int,score:double>>")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, learnt without the held-out quarter of the labels."""
    docs = frames.table(spark, sf_dir, "documents")
    held_out = frames.residue("doc_id", 4) == 2
    model = train(docs, frames.table(spark, sf_dir, "labels"), ~held_out)
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.expr("filter(sentences, s -> s.score >= 0.5)").alias("offending"))


def below(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose text scores below the threshold; each row is judged by its own text, whatever its id."""
    shared = frames.shared(docs.sparkSession, "toxicity", model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared())
        for whole in batches:
            for batch in frames.slices(iter([whole]), "text"):
                mask = [scorer.score(text or "")[0] < threshold for text in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of `docs` whose score stays below the threshold.

    Null and empty texts have the leak's score and stay. Rows with a null id, and rows that repeat an id, are judged by their own text.
    An empty table stays empty. All columns come back as they are.
    """
    return below(docs, train(docs, frames.table(spark, sf_dir, "labels"), ~(frames.residue("doc_id", 4) == 2)))
