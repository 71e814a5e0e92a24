"""The document registry: one row for each file, heuristic and override settings side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(registry: DataFrame, scanned: DataFrame) -> DataFrame:
    """``registry`` (key, enabled, doc_type, page_count, last_scanned, override_mode) with the scan's rows (key,
    doc_type, page_count, last_scanned): known keys get what was scanned and keep the rest; nothing is deleted."""
    s = scanned.select("key", *[F.col(c).alias(f"_{c}") for c in ("doc_type", "page_count", "last_scanned")], F.lit(True).alias("_seen"))
    j = registry.join(s, "key", "full_outer")
    new = lambda c: F.when(F.col("_seen"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return j.select("key", F.coalesce("enabled", F.lit(True)).alias("enabled"), new("doc_type"), new("page_count"), new("last_scanned"), "override_mode")


def enabled(registry: DataFrame, key: str | None = None) -> DataFrame:
    """The named document, whether enabled or not; without a name all enabled ones."""
    return registry.where(F.col("key") == key) if key else registry.where("enabled")


def layered(registry: DataFrame, defaults: dict, cli: dict | None = None) -> DataFrame:
    """Settings of each document: the command line's, else its override, else its heuristic value, else the default.

    ``registry`` has override_<name> and heuristic_<name> columns for each name of ``defaults``."""
    cli = cli or {}
    have = set(registry.columns)
    pick = lambda n: F.coalesce(*([F.lit(cli[n])] if n in cli else []), *[F.col(c) for c in (f"override_{n}", f"heuristic_{n}") if c in have], F.lit(defaults[n])).alias(n)
    return registry.select("key", *[pick(n) for n in defaults])


def type_counts(registry: DataFrame) -> DataFrame:
    return registry.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"))
