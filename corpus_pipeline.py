"""The corpus pipeline over `documents`: five stages, each written and read again as Parquet.

Toxic documents go, one document of each group of near copies stays, documents that hold benchmark items go, personal data gets
surrogates, and what is left is encoded. All stages but the last return the columns of `documents`.
"""
from __future__ import annotations

import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import filestrata
from filestrata.llm import byte_bpe, decontaminate, near_copies, private_data, toxicity
from filestrata.session import checkpoint_folder

# Python workers get the package's functions with the job, also where it is not installed.
cloudpickle.register_pickle_by_value(filestrata)


def toxic_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(spark, docs, sf_dir)


def copies_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def leaks_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(spark, docs, sf_dir)


def surrogates_written(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return private_data.private_removed(spark, docs, sf_dir)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs, byte_bpe.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("toxicity", toxic_removed), ("near_copies", copies_removed), ("decontamination", leaks_removed), ("surrogates", surrogates_written),
    ("byte_bpe", encoded),
]
#: Trained scores, latent spaces and merges cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over `documents`; what the stages hand on lies in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4()}"
    for place, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{place}-{name}")
        docs = spark.read.parquet(f"{folder}/{place}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
