"""Registered queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import (
    alignment,
    bpe,
    context_tree,
    importance,
    jaccard,
    mixing,
    order_minhash,
    page_text,
    pii,
    repair,
    setsketch,
    substring_dedup,
    topk,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and their decoding, as digests."""
    bpe.check_pattern(public_tokenizers.PATTERN)
    return bpe.bpe_encode(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


@query(
    "op4_norm_topk",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT::DOUBLE) AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
        FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
        WHERE q.vec_id % 100 = 0
    )
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
    FROM scored
    QUALIFY rank <= 10
    """,
)
def op4_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector among all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op6_order_minhash")
def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-sensitive fingerprints of every text and its edited form."""
    return order_minhash.edit_report(table(spark, sf_dir, "documents"))


@query("op7_temperature_mix")
def op7_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most even mixture of sources that repeats no source more than twice, by document and epoch."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), max_repeats=2.0)
    return mixed.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_weight").alias("weight"))


@query("op9_context_tree")
def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by context-tree weighting and by word frequencies, learnt from four folds of five."""
    return context_tree.score(table(spark, sf_dir, "documents"))


@query("op3_importance")
def op3_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance weight, its noisy key, and whether resampling keeps it."""
    _, least, weights = importance.decide(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return weights.withColumn("kept", F.col("gumbel_key") >= least)


@query("op5_field_pii")
def op5_field_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts by pattern, a digest of the pattern spans, and all spans."""
    return pii.find(table(spark, sf_dir, "documents"))


@query("op2_count_vector_join")
def op2_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates: four-word shingles, similarity 0.85."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), width=4, share=85)


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 35-word windows that start anywhere else too."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=35)


@query("op8_page_lstm")
def op8_page_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return page_text.extract(table(spark, sf_dir, "pages"))


@query("op11_setsketch")
def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates: five-word shingles, similarity 0.85."""
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), width=5, share=85)


@query("op12_dawg_repair")
def op12_dawg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's damage and its cheapest repair."""
    return repair.repair(table(spark, sf_dir, "conversations"))


@query("op13_pair_bitmaps")
def op13_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's links between the tokens of two tokenizers, and how common they are."""
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align(table(spark, sf_dir, "documents"), *paths)[0]
