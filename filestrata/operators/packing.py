"""Compressed payloads: pack, unpack and verify."""
from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def _codec(name: str):
    """(pack, unpack) for ``zstd_b64``; zlib at level 9 where zstandard is not installed."""
    try:
        import zstandard
    except ImportError:
        return (lambda data: zlib.compress(data, 9)), zlib.decompress
    packer, unpacker = zstandard.ZstdCompressor(level=10), zstandard.ZstdDecompressor()

    def unpack(data: bytes) -> bytes:
        try:
            return unpacker.decompress(data)
        except zstandard.ZstdError:
            return zlib.decompress(data)

    return packer.compress, unpack


@F.pandas_udf(T.BinaryType())
def _packed(data: pd.Series) -> pd.Series:
    pack, _ = _codec("zstd_b64")
    return data.map(pack, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def _unpacked(data: pd.Series) -> pd.Series:
    _, unpack = _codec("zstd_b64")
    return data.map(unpack, na_action="ignore")


def pack(data: Column, codec: str = "zstd_b64") -> Column:
    """Unbroken Base64 text of the bytes, compressed unless the codec is ``none``."""
    encoded = F.base64(data if codec == "none" else _packed(data))
    return F.replace(encoded, F.lit("\r\n"), F.lit(""))


def unpack(payload: Column, codec: str = "zstd_b64") -> Column:
    data = F.unbase64(payload)
    return data if codec == "none" else _unpacked(data)


def packed_files(files: DataFrame, codec: str = "zstd_b64") -> DataFrame:
    data = F.col("content_bytes")
    return files.filter(data.isNotNull()).select(
        "project_id", "path", F.octet_length(data).cast("long").alias("size_bytes"),
        F.sha2(data, 256).alias("sha256"), F.lit(codec).alias("codec"),
        pack(data, codec).alias("payload"))


def verified(payloads: DataFrame, codec: str = "zstd_b64") -> DataFrame:
    """Decode every payload and compare its hash with the stored one."""
    data = unpack(F.col("payload"), codec)
    return payloads.withColumn("actual", F.sha2(data, 256)).select(
        "project_id", "path", "sha256", "actual", (F.col("sha256") == F.col("actual")).alias("intact"))


def mismatches(payloads: DataFrame, codec: str = "zstd_b64") -> DataFrame:
    return verified(payloads, codec).filter("NOT intact")
