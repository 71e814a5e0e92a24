"""A training-corpus pipeline in five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontam, langid, linedup, minhash, packing
from leafmill.llm.common import broadcast_if_small, clear, delete, shared_dir, stage, staged

#: Documents whose language is known with less than this share are rejected.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language.

    Null and empty texts, and texts without a letter, go. Repeated rows are judged alike. Where no document has a label,
    every text with a letter stays. An empty table gives none.
    """
    return langid.recognised(docs, LEAST_SHARE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated three-line passages; documents that lose all their text that way go.

    Null and empty texts stay as they are, and so do rows of a null doc_id. Of equal passages the first by (doc_id,
    position) stays; rows that repeat a doc_id and text count as one document. An empty table gives none.
    """
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    out = linedup.dedup_lines(rows).where("n_removed = 0 or n_removed < n_lines")
    now = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return out.select(*[now.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group.

    Rows are taken out by id and text, so a different text under the same id is judged alone; rows that repeat both stay
    together. Texts without words and rows of a null doc_id stay. An empty table gives none.
    """
    gone = stage(minhash.near_groups(docs, percent=80).where("not kept").select("doc_id", F.col("text_hash").alias("_text")).distinct(), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("_text"))
    return rows.join(broadcast_if_small(gone, gone.count()), ["doc_id", "_text"], "left_anti").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark passage.

    Null and empty texts and rows of a null doc_id stay. Rows of one doc_id are judged together. An empty table on
    either side takes nothing away.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all remaining documents into sequences of 1024 ids; null and empty texts hold the end id alone. Repeated rows
    are packed each; an empty table gives none."""
    return packing.best_fit(docs)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pack", pack),
]
#: No SQL for the whole: tokenization and packing can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES:
        mark, path = staged(), f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        # what the stage was made from is read no more; only the last stage's table stays
        clear(spark, mark)
        if before:
            delete(spark, before)
        before = path
    return docs
