"""From raw documents to token ids: five stages, each written as Parquet and read again.

Rows without text pass the first four stages as empty texts do; an empty table stays
empty; further columns of ``documents`` are carried through the first four stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import bpe, importance, jaccard, mixing, pii
from leafmill.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what importance resampling towards well labelled text keeps."""
    return importance.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that shares four fifths of its five-word shingles."""
    return jaccard.keep_one(docs, width=5, share=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of every span of personal data."""
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The most even mixture of sources that takes no document more than twice."""
    return mixing.mix(docs, max_repeats=2.0).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and a digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.bpe_encode(docs, path, public_tokenizers.PATTERN, outputs=("n_tokens", "ids", "decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mixture", mixture),
    ("byte_bpe", token_ids),
]

# A fitted field and resampling are not SQL; tests/llm holds the stages' operators to small fixtures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
