"""Incremental runs over a growing folder of cards, with the index of earlier runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.dedup import comparison_text, content_hash, first_of


def read_cards(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def new_cards(stream: DataFrame, index: str, sink: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None):
    """Runs all that has come in, batch by batch: cards whose content no earlier batch had go to ``sink``, their hashes
    to ``index``. A batch that is run again writes the same files again."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        seen = spark.read.schema("content_hash string, batch bigint").parquet(index).where(F.col("batch") < number)
        c = df.withColumn("content_hash", content_hash(comparison_text()))
        left = first_of(c.join(seen.select("content_hash").distinct(), "content_hash", "left_anti"), F.col("content_hash")).withColumn("batch", F.lit(number).cast("bigint"))
        # the folder is named by the batch, so a second try replaces the first
        left.write.mode("overwrite").parquet(f"{sink}/run={number}")
        spark.read.parquet(f"{sink}/run={number}").select("content_hash", "batch").write.mode("overwrite").parquet(f"{index}/run={number}")
        if each:
            each(left, number)

    spark = stream.sparkSession
    spark.createDataFrame([], "content_hash string, batch bigint").write.mode("ignore").parquet(f"{index}/run=-1")
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
