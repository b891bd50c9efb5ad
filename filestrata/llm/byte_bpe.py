"""Byte-level BPE by a sentencepiece model that is written directly from a rank file.

Each byte b stands as the character 256 + b, so every initial symbol is one byte; the score of a piece is
its negative rank, and the normaliser is the identity. A sentencepiece BPE model then merges, at each
step, the leftmost adjacent pair of lowest rank, as rank files ask for. Pre-tokens are the matches of a
pattern and are encoded one by one; decoding maps pieces back to bytes.

Null and empty texts have no tokens. Rows come back as often as they went in.
"""
from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from . import frames

_TO_PIECE = {b: 256 + b for b in range(256)}
_TO_BYTE = {256 + b: b for b in range(256)}
#: Cached pre-tokens of a worker; beyond it the cache starts anew.
CACHED = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _chunk(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _single(field: int, value: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", value)


def as_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(_TO_PIECE)


def as_bytes(piece: str) -> bytes:
    return piece.translate(_TO_BYTE).encode("latin-1")


def model_of(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model; a piece's id is its rank, and the unknown piece comes last."""
    # Field numbers and enum values of sentencepiece's public model format.
    pieces, trainer, normaliser = 1, 2, 3
    normal, unknown, bpe = 1, 2, 2
    ordered = sorted(ranks.items(), key=lambda item: item[1])
    if [rank for _, rank in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must run from 0 without gaps")
    body = [_chunk(pieces, _chunk(1, as_piece(t).encode()) + _single(2, -float(r)) + _number(3, normal)) for t, r in ordered]
    body.append(_chunk(pieces, _chunk(1, b"<unk>") + _single(2, 0.0) + _number(3, unknown)))
    body.append(_chunk(trainer, _number(3, bpe) + _number(40, len(ordered)) + _number(41, 2**64 - 1)
                       + _number(42, 2**64 - 1) + _number(43, 2**64 - 1)))
    body.append(_chunk(normaliser, _chunk(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)))
    return b"".join(body)


class Codec:
    """Encodes and decodes texts; holds the ids of pre-tokens it has met, packed as 32-bit integers."""

    def __init__(self, model: bytes, pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.match = regex.compile(pattern).findall
        size = self.processor.get_piece_size() - 1
        self.pieces = [as_bytes(self.processor.id_to_piece(i)) for i in range(size)]
        self.whole = {piece: i for i, piece in enumerate(self.pieces)}
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        tokens = [self.match(text) for text in texts]
        missing = list(set().union(*tokens).difference(self.cache))
        if len(self.cache) + len(missing) > CACHED:
            self.cache.clear()
            missing = list(set().union(*tokens))
        # A pre-token that is a token itself stays whole, whether or not merges lead there.
        as_utf8 = [token.encode() for token in missing]
        split = [i for i, token in enumerate(as_utf8) if token not in self.whole]
        ids = self.processor.encode([as_piece(as_utf8[i]) for i in split], out_type=int, num_threads=1)
        self.cache.update((missing[i], struct.pack(f"<{len(found)}I", *found)) for i, found in zip(split, ids))
        for text, token in zip(missing, as_utf8):
            if token in self.whole:
                self.cache[text] = struct.pack("<I", self.whole[token])
        return [b"".join(map(self.cache.__getitem__, found)) for found in tokens]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def _mapped(docs: DataFrame, path: str, pattern: str, schema: str, rows) -> DataFrame:
    """`rows(ids, packed, codec)` gives the columns for the texts of a slice."""
    model = docs.sparkSession.sparkContext.broadcast(model_of(read_ranks(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = frames.kept(f"codec {path} {pattern}", lambda: Codec(model.value, pattern))
        for batch in frames.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(*rows(batch.column("doc_id"), codec.encode(batch.column("text").to_pylist()), codec))

    return frames.texts(docs).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """`doc_id` and `ids`, the token ids of each text."""

    def rows(ids, packed, codec):
        sizes = np.fromiter((len(x) // 4 for x in packed), dtype=np.int64, count=len(packed))
        flat = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        return [ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"]

    return _mapped(docs, path, pattern, "doc_id long, ids array<int>", rows)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """`doc_id` and `bytes`, what the token ids of each row stand for; a null list is empty."""
    model = tokens.sparkSession.sparkContext.broadcast(model_of(read_ranks(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = frames.kept(f"codec {path}", lambda: Codec(model.value, public_tokenizers.PATTERN))
        for batch in batches:
            found = [codec.decode(np.asarray(x or [], dtype="<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encodes and decodes each text: `doc_id, n_tokens, ids_sha256, decoded_sha256, lossless`."""

    def rows(ids, packed, codec):
        decoded = [codec.decode(x) for x in packed]
        return [
            ids, frames.longs([len(x) // 4 for x in packed]),
            pa.array([hashlib.sha256(x).hexdigest() for x in packed]),
            pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
        ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    return _mapped(docs, path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the multilingual rank file, and the digest of what they decode to."""
    return round_trip(frames.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
