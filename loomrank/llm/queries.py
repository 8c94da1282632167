"""Queries of the llm operators, one per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontam, lm, minhash, quality, secrets, sharding, sql, suffix_dedup, toxicity
from ._runtime import load


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(load(spark, sf_dir, "documents")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(load(spark, sf_dir, "documents")).drop("found")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(load(spark, sf_dir, "documents")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(load(spark, sf_dir, "documents"), 8)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_weights(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(load(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_ann, op3_bpe, op4_secrets, op5_suffix_dedup, op6_sharding, op7_quality, op8_decontam, op9_lm, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": sql.OP1, "op2_ann": sql.OP2, "op4_secrets": sql.OP4, "op5_suffix_dedup": sql.OP5, "op6_sharding": sql.OP6, "op8_decontam": sql.OP8}
