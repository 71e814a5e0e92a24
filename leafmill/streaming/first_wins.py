"""First-wins over a stream with state in Spark's state store, keyed by content hash.

Nothing of earlier batches is read again: a key's state says that its content was seen. Of equal cards in one batch the
first by card_ord is kept, so a run over many batches keeps what ``incremental.new_cards`` keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from leafmill.operators.dedup import comparison_text, content_hash
from leafmill.plans.ship import ship

#: The state store that keyed state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfContent(StatefulProcessor):
    """Emits a key's first card, once for all batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "card_ord bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the names are Spark's
        if self.seen.exists():
            for _ in rows:  # nothing of it is new
                pass
            return
        first = None
        for part in rows:
            if not len(part):
                continue
            least = part.nsmallest(1, "card_ord")
            if first is None or least["card_ord"].iloc[0] < first["card_ord"].iloc[0]:
                first = least
        if first is not None:
            self.seen.update((int(first["card_ord"].iloc[0]),))
            yield first

    def close(self) -> None:
        pass


def first_cards(stream: DataFrame) -> DataFrame:
    """The stream's cards (with card_ord) whose content no earlier batch had, the first of each content, with content_hash."""
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    c = stream.withColumn("content_hash", content_hash(comparison_text()))
    return c.groupBy("content_hash").transformWithStateInPandas(FirstOfContent(), outputStructType=c.schema, outputMode="Append", timeMode="None")


def run(stream: DataFrame, sink: str, checkpoint: str):
    """Runs all that has come in and writes new cards to ``sink`` (Parquet, each batch once, also over restarts)."""
    query = first_cards(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
