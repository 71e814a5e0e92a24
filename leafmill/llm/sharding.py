"""Shards of near equal bytes, tokens and rows: vector bin packing by the dot product with residual capacity.

Documents of equal text form a group and stay together, unless a group holds more than a whole shard's share of any
measure; such a group is cut into as few parts as fit, by a hash of doc_id, and ``group_parts`` says so. Groups are placed largest first, each on the
shard for which the dot product of its (bytes, tokens, rows) shares with the shard's residual capacity is highest.

Scale: the few heavy groups (at most 3 * 64 * shards of them can hold a 64th of a shard each) are placed on the driver.
The others are dealt by hash into cells of about ``CELL`` groups; each cell places its groups alone, into its part of
what the heavy groups left free. Only numbers move; texts are read once and never shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import scan, stage, text_or_empty, tokenizer_path, unstage
from leafmill.llm.tokens import bpe
from leafmill.plans.ship import ship

CELL = 8_192
MEASURES = ("size", "tokens", "rows")
#: Weights of the measures in the dot product: bytes are the law, the others follow as far as they can.
WEIGHTS = np.array([16.0, 1.0, 1.0])


def place(loads: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The shard of each row of ``loads`` (in the given order); ``free``: residual capacity (shards x measures), changed
    in place. Ties go to the shard with most free bytes, then to the lowest number."""
    out = np.empty(len(loads), np.int64)
    for i, v in enumerate(loads):
        dots = free @ (v * WEIGHTS)
        k = int(dots.argmax())
        ties = np.flatnonzero(dots == dots[k])
        if len(ties) > 1:
            k = int(ties[free[ties, 0].argmax()])
        out[i] = k
        free[k] -= v
    return out


def measured(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, tokens, h1, h2 of each row; tokens are counted by the tokenizer, without special ones."""
    text = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    path = tokenizer or tokenizer_path()

    def one(b: pa.RecordBatch) -> dict:
        return {**{c: b.column(c) for c in ("doc_id", "size", "text_crc32", "h1", "h2")}, "tokens": bpe(path).encode(b.column("text"))[1]}

    return scan(rows, "doc_id bigint, size bigint, text_crc32 bigint, tokens bigint, h1 bigint, h2 bigint", one)


def balanced(docs: DataFrame, shards: int = 8, tokenizer: str | None = None, cell: int = CELL) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens, group_parts of each row.

    Size is the text's UTF-8 bytes plus 1. Tokens are byte-level BPE's unless another tokenizer file is given. A null text counts as empty;
    all empty texts are one group. Repeated rows are rows of one group. An empty table gives none. A null doc_id is
    hashed like any other. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = measured(docs, tokenizer)
    rows = stage(rows, "sizes")
    groups = stage(rows.groupBy("h1", "h2").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "groups")
    got = groups.agg(*[F.sum(m).alias(m) for m in MEASURES], F.count(F.lit(1)).alias("n")).first()
    total = np.array([max(got[m] or 0, 1) for m in MEASURES], np.float64)
    share = F.greatest(*[F.col(m) / float(t) for m, t in zip(MEASURES, total)])
    heavy = groups.withColumn("share", share).where(F.col("share") > 1 / (64 * shards)).toPandas()  # bounded by 3 * 64 * shards
    heavy["parts"] = np.ceil(heavy["share"] * shards).clip(lower=1).astype(int)

    # a part of a cut group is known by doc_id's hash; the parts' own sizes are summed again
    big = spark.createDataFrame([(int(a), int(b), int(p)) for a, b, p in zip(heavy.h1, heavy.h2, heavy.parts)], "h1 bigint, h2 bigint, parts int")
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    of_big = rows.join(F.broadcast(big), ["h1", "h2"]).withColumn("part", part)
    pieces = of_big.groupBy("h1", "h2", "part").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).toPandas()
    pieces = pieces.sort_values(["size", "rows", "h1", "h2", "part"], ascending=[False, False, True, True, True], kind="stable")
    free = np.repeat((1 / shards) * np.ones((1, 3)), shards, axis=0)
    pieces["shard"] = place(pieces[list(MEASURES)].to_numpy(np.float64) / total, free)
    free = np.maximum(free, 0)
    free = free / free.sum(axis=0).clip(min=1e-12)

    cells = max(1, round((got["n"] or 0) / cell))

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["size", "h1", "h2"], ascending=[False, True, True], kind="stable")
        loads = g[list(MEASURES)].to_numpy(np.float64)
        loads = loads / loads.sum(axis=0).clip(min=1)
        return g[["h1", "h2"]].assign(shard=place(loads, free.copy()).astype("int32"))

    light = groups.join(F.broadcast(big), ["h1", "h2"], "left_anti").withColumn("cell", F.pmod("h1", F.lit(cells)))
    light = light.groupBy("cell").applyInPandas(one, "h1 bigint, h2 bigint, shard int")
    at = spark.createDataFrame([(int(a), int(b), int(p), int(s)) for a, b, p, s in zip(pieces.h1, pieces.h2, pieces.part, pieces.shard)], "h1 bigint, h2 bigint, part int, shard int")
    placed = of_big.join(F.broadcast(at), ["h1", "h2", "part"]).select("doc_id", "size", "text_crc32", "tokens", "shard", "parts")
    rest = rows.join(F.broadcast(big), ["h1", "h2"], "left_anti").join(light, ["h1", "h2"]).select("doc_id", "size", "text_crc32", "tokens", "shard", F.lit(1).alias("parts"))
    out = slotted(placed.unionByName(rest))
    for x in (rows, groups):
        unstage(x)
    return out


def slotted(rows: DataFrame, law: str = "bytes") -> DataFrame:
    """Adds gapless slots in each shard: numbers inside small parts, after the parts before."""
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(rows.withColumn("_p", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int")), "placed")
    before = rows.groupBy("shard", "_p").agg(F.count(F.lit(1)).alias("n"))  # shards * parts rows
    before = before.select("shard", "_p", (F.sum("n").over(Window.partitionBy("shard").orderBy("_p")) - F.col("n")).alias("_before"))
    inside = Window.partitionBy("shard", "_p").orderBy("doc_id", "size", "text_crc32")
    rows = rows.join(F.broadcast(before), ["shard", "_p"])
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("_before") + F.row_number().over(inside) - 1).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "tokens", F.col("parts").alias("group_parts"),
    )
