"""Token counts of texts of any length, by overlapping chunks that are spliced where they agree.

A huge text is cut into chunks that overlap. Every chunk is split into pre-tokens with their offsets. A
pattern of pre-tokens reads from left to right and looks at most one character ahead, so what follows a
pre-token boundary depends on the text from there on alone. An offset at which both the left chunk, which
begins at a true boundary, and the right chunk end a pre-token is therefore a true boundary, and the right
chunk is right from there on. Offsets closer to either chunk's cut than the longest special string are
not used, as a cut special string reads as ordinary text. Where no offset is common, the overlap is
doubled; where it would reach back to the last splice, the left chunk is doubled.

Tokens of one pre-token do not depend on its neighbours; each distinct one is encoded by the library once
per worker. Null and empty texts have no tokens. Rows come back as often as they went in.
"""
from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import public_tokenizers
import regex
import tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import frames

#: Characters for which the library's pattern and Python's agree on letters, digits and white space.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏΑ-ΡΣ-Ωα-ωА-я]")
#: Cached pre-tokens of a worker; beyond it the cache starts anew.
CACHED = 400_000


class Counter:
    """Counts tokens as the library does for a byte-level tokenizer file without a normaliser."""

    def __init__(self, path: str):
        with open(path) as f:
            stored = json.load(f)
        kind = stored["pre_tokenizer"] or {}
        if stored["normalizer"] or stored["truncation"] or kind.get("type") != "ByteLevel" or kind["add_prefix_space"] \
                or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in stored["added_tokens"]):
            raise ValueError("the splice is proven for plain byte-level tokenizers only")
        self.library = tokenizers.Tokenizer.from_file(path)
        specials = sorted((t["content"] for t in stored["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.guard = max(map(len, specials), default=0) + 1
        self.match = regex.compile(public_tokenizers.PATTERN).findall
        self.cache: dict[str, int] = {x: 1 for x in specials}

    def _split(self, text: str) -> list[str]:
        if not _OTHER.search(text):
            return self.match(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens and special strings in order; together they are the text."""
        if self.special is None or not self.special.search(text):
            return self._split(text)
        out, at = [], 0
        for found in self.special.finditer(text):
            out += self._split(text[at:found.start()])
            out.append(found.group())
            at = found.end()
        return out + self._split(text[at:])

    def learn(self, tokens: set[str]) -> None:
        missing = list(tokens.difference(self.cache))
        if len(self.cache) + len(missing) > CACHED:
            special = {} if self.special is None else {x: 1 for x in self.cache if self.special.fullmatch(x)}
            self.cache.clear()
            self.cache.update(special)
            missing = list(tokens.difference(self.cache))
        self.cache.update(zip(missing, (len(x.ids) for x in self.library.encode_batch(missing, add_special_tokens=False))))

    def whole(self, texts: list[str]) -> list[int]:
        tokens = [self.pre_tokens(text) for text in texts]
        self.learn(set().union(*tokens))
        return [sum(map(self.cache.__getitem__, found)) for found in tokens]

    def spliced(self, text: str, chunk: int, overlap: int) -> tuple[int, int, int]:
        """Tokens of a long text, the chunks it took, and how often an overlap or chunk was widened."""
        total, begin, chunks, widened = 0, 0, 1, 0
        left = self.pre_tokens(text[:chunk])
        cut = min(chunk, len(text))
        while cut < len(text):
            ends = list(accumulate(map(len, left), initial=begin))[1:]
            width, found = overlap, None
            while found is None and cut - width > begin:
                start = cut - width
                right = self.pre_tokens(text[start:start + width + chunk])
                chunks += 1
                right_ends = list(accumulate(map(len, right), initial=start))[1:]
                common = {p for p in right_ends if start + self.guard <= p <= cut - self.guard}.intersection(ends)
                if common:
                    found = max(common)
                else:
                    width, widened = 2 * width, widened + 1
            if found is None:
                cut = min(len(text), begin + 2 * (cut - begin))
                left, chunks, widened = self.pre_tokens(text[begin:cut]), chunks + 1, widened + 1
                continue
            done = left[:bisect_right(ends, found)]
            self.learn(set(done))
            total += sum(map(self.cache.__getitem__, done))
            left, begin = right[bisect_right(right_ends, found):], found
            cut = min(start + width + chunk, len(text))
        self.learn(set(left))
        return total + sum(map(self.cache.__getitem__, left)), chunks, widened


def token_counts(docs: DataFrame, path: str, limit: int = 512, chunk: int = 65_536, overlap: int = 512) -> DataFrame:
    """`doc_id, n_bytes, n_tokens, over_limit, n_chunks, n_widened` of each text, whole however long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = frames.kept(f"counter {path}", lambda: Counter(path))
        for batch in frames.slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            short = [i for i, text in enumerate(texts) if len(text) <= chunk]
            found = dict(zip(short, ((n, 1, 0) for n in counter.whole([texts[i] for i in short]))))
            rows = [found[i] if i in found else counter.spliced(text, chunk, overlap) for i, text in enumerate(texts)]
            counts = [n for n, _, _ in rows]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), frames.longs([len(text.encode()) for text in texts]), frames.longs(counts),
                pa.array([n > limit for n in counts]), frames.longs([c for _, c, _ in rows]), frames.longs([w for _, _, w in rows]),
            ], ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"])

    return frames.texts(docs).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long, n_widened long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by the byte-level tokenizer file."""
    return token_counts(frames.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
