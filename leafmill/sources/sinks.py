"""Files out: card tables, images, indices, deck packages, manifests."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.sources.files import CARD_COLUMNS


def card_columns(cards: DataFrame) -> DataFrame:
    """All card columns as text (missing ones empty, lists joined by semicolons), others behind them."""
    kinds = dict(cards.dtypes)
    text = lambda c: F.concat_ws(";", c) if kinds[c].startswith("array") else F.to_json(c) if kinds[c].startswith(("struct", "map")) else F.coalesce(F.col(c).cast("string"), F.lit(""))
    more = [c for c in cards.columns if c not in CARD_COLUMNS and c != "card_ord"]
    order = [F.col("card_ord")] if "card_ord" in kinds else []
    return cards.select(*order, *[(text(c) if c in kinds else F.lit("")).alias(c) for c in CARD_COLUMNS], *[text(c).alias(c) for c in more])


def save_cards(cards: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header. ``single``: one file in card order, for tables that one task can write; else as many files as
    there are partitions, in ranges of card order."""
    out = card_columns(cards)
    if "card_ord" in out.columns:
        out = out.coalesce(1).sortWithinPartitions("card_ord") if single else out.repartitionByRange("card_ord").sortWithinPartitions("card_ord")
        out = out.drop("card_ord")
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def save_images(images: DataFrame, path: str) -> None:
    """filename, content as rows of a table in the shared file system: workers have no common local folder."""
    images.select("filename", "content").write.mode("overwrite").parquet(path)


def export_images(spark, path: str, folder: str) -> list[str]:
    """Saved images one by one into a folder of the driver; names in order."""
    os.makedirs(folder, exist_ok=True)
    names = []
    for r in spark.read.parquet(path).orderBy("filename").toLocalIterator():
        with open(os.path.join(folder, r["filename"]), "wb") as f:
            f.write(bytes(r["content"]))
        names.append(r["filename"])
    return names


def save_index(index: DataFrame, path: str) -> None:
    """A hash or vector index, replaced as a whole; never pickled."""
    index.write.mode("overwrite").json(path) if index.columns == ["content_hash"] else index.write.mode("overwrite").parquet(path)


def _path(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def clear_cache(spark, path: str) -> int:
    """Deletes a table of cached responses; the number of its rows (0 where there is none)."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return 0
    n = spark.read.parquet(path).count()
    fs.delete(p, True)
    return n


def backup(spark, path: str, suffix: str = ".bak") -> str | None:
    """Copies a file or folder beside itself, over an older copy; the copy's path, or None where there is nothing."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    to, _ = _path(spark, path + suffix)
    fs.delete(to, True)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, fs, to, False, spark._jsparkSession.sessionState().newHadoopConf())
    return path + suffix


def save_manifest(data: dict, path: str, now: str | None = None) -> None:
    from datetime import datetime

    with open(path, "w", encoding="utf-8") as f:
        json.dump({**data, "generated_at": now or datetime.now().isoformat()}, f, indent=2, default=str)


def load_manifest(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return {}


def save_package(notes: DataFrame, decks: DataFrame, path: str) -> None:
    """Notes and decks as Parquet under one folder; an empty deck package is an error. Notes are made once: what was written
    is looked at, not made again to be counted."""
    notes.write.mode("overwrite").parquet(f"{path}/notes")
    if notes.sparkSession.read.schema(notes.schema).parquet(f"{path}/notes").isEmpty():
        raise ValueError("no notes to package")
    decks.write.mode("overwrite").parquet(f"{path}/decks")


def sample_schema(note_types: dict[str, list[str]]) -> list[dict]:
    """One example row for each note type over the sorted union of all fields; empty where a type lacks the field."""
    fields = sorted({f for fs in note_types.values() for f in fs})
    return [{"note_type": t, **{f: f"Example {f}" if f in fs else "" for f in fields}} for t, fs in sorted(note_types.items())]
