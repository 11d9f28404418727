"""The queries of this subpackage: thin, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, language, minhash, mixing, oracles, secrets, sharding, substring, suffixes, topk, toxicity
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), n_shards=24)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=20, k=20).drop("query_hash")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train_on(docs))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("text_hash")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.all_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all pages, with models trained on a bounded sample of the labelled documents."""
    model = language.train(table(spark, sf_dir, "documents"))
    found = language.identify(table(spark, sf_dir, "pages"), model, "page_id", "html", address_col="url", markup=True)
    return found.withColumnRenamed("row_id", "page_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_substring_dedup, op3_suffix_array_dedup, op4_exact_top_k, op5_minhash_near_dedup, op6_toxicity, op7_secret_scan, op8_mixing, op9_decontamination, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query. It has no CRC32 for op1 and no trained models for op6, op7 and op10."""
    return {"op2_substring_dedup": oracles.SUBSTRING_DEDUP, "op3_suffix_array_dedup": oracles.SUFFIX_DEDUP, "op9_decontamination": oracles.DECONTAMINATION, "op4_exact_top_k": oracles.TOP_K, "op5_minhash_near_dedup": oracles.NEAR_DUPLICATES, "op8_mixing": oracles.MIXING}
