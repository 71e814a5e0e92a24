"""One query for each operator over its whole tables, and SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import centroids, decontam, divergence, fingerprint, langid, linedup, minhash, packing, sharding, tokenbin, tokencount, toxicity, windows
from leafmill.llm.common import shared_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(documents(spark, sf_dir))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_and_next(documents(spark, sf_dir))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/leafmill-file-{uuid.uuid4().hex}"
    tokenbin.write(documents(spark, sf_dir), path)
    return tokenbin.index(spark, path)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced(documents(spark, sf_dir), shards=8)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.line_report(documents(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_near_equal_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.near_equal_windows(documents(spark, sf_dir))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_fingerprints": op2_fingerprints,
    "op3_token_ids": op3_token_ids,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_line_dedup": op7_line_dedup,
    "op8_language": op8_language,
    "op9_decontamination": op9_decontamination,
    "op10_token_counts": op10_token_counts,
    "op11_source_divergence": op11_source_divergence,
    "op12_near_equal_packing": op12_near_equal_packing,
    "op13_centroids": op13_centroids,
}
ORACLES: dict[str, str] = {
    "op7_line_dedup": linedup.LINE_SQL,
    "op11_source_divergence": divergence.AUDIT_SQL,
    "op13_centroids": centroids.cluster_sql(),
}
