"""The document registry as a YAML file on the driver, and as a table with one row for each document."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: What is known of a document, and the settings that can be proposed or overridden.
METADATA = {
    "page_count": "int", "toc_present": "boolean", "chapters_detected": "boolean", "abstract_present": "boolean", "references_present": "boolean", "two_column_layout": "boolean",
    "has_doi": "boolean", "doc_type": "string", "file_size": "bigint", "created_date": "string", "modified_date": "string",
}
CHUNKING = {
    "mode": "string", "tokens_per_chunk": "int", "overlap_tokens": "int", "respect_page_bounds": "boolean", "min_chunk_tokens": "int", "max_chunk_tokens": "int", "enable_trimming": "boolean",
    "token_budget": "int",
}
SCHEMA = ", ".join([
    "key string, file_path string, file_hash string, enabled boolean, last_scanned string", *[f"{n} {t}" for n, t in METADATA.items()],
    *[f"{kind}_{n} {t}" for kind in ("heuristic", "override") for n, t in CHUNKING.items()], "heuristic_strategies array<string>", "override_strategies array<string>",
])


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry's rows; none where the file doesn't exist. Documents are enabled unless they say otherwise."""
    import yaml

    data = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
    schema = T._parse_datatype_string(SCHEMA)
    rows = []
    for key, d in (data.get("documents") or {}).items():
        flat = {"key": key, "enabled": True, **{n: d.get(n) for n in ("file_path", "file_hash", "last_scanned", "heuristic_strategies", "override_strategies")}}
        flat |= {n: (d.get("metadata") or {}).get(n) for n in METADATA}
        flat |= {f"{kind}_{n}": (d.get(f"{kind}_chunking") or {}).get(n) for kind in ("heuristic", "override") for n in CHUNKING}
        if d.get("enabled") is not None:
            flat["enabled"] = bool(d["enabled"])
        rows.append(tuple(flat.get(n) for n in schema.names))
    return spark.createDataFrame(rows, schema)


def save_registry(registry: DataFrame, path: str, version: str = "1.0", global_overrides: dict | None = None) -> None:
    """Writes the rows, by key, in the form that ``load_registry`` reads. Missing columns and empty parts are null."""
    import yaml

    documents = {}
    for r in registry.orderBy("key").toLocalIterator():
        d = r.asDict(recursive=True)
        part = lambda names, before="": {n: d.get(before + n) for n in names} if any(d.get(before + n) is not None for n in names) else None
        documents[d["key"]] = {
            "file_path": d.get("file_path"), "file_hash": d.get("file_hash"), "metadata": part(METADATA), "heuristic_chunking": part(CHUNKING, "heuristic_"),
            "heuristic_strategies": d.get("heuristic_strategies"), "override_chunking": part(CHUNKING, "override_"), "override_strategies": d.get("override_strategies"),
            "enabled": d.get("enabled", True), "last_scanned": d.get("last_scanned"),
        }
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump({"version": version, "documents": documents, "global_overrides": global_overrides}, f, sort_keys=False)
