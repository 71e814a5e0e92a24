"""Files in: discovery, extracted documents, card tables, JSON indices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.text import strip
from leafmill.plans.ship import ship

#: What is kept of a file's metadata.
METADATA = ("title", "author", "subject", "creator", "producer", "creation_date", "modification_date")
PAGES = "path string, page_num int, raw_text string"
#: The columns of a saved card table.
CARD_COLUMNS = (
    "id", "deck", "note_type", "tags", "media", "front", "back", "cloze_text", "extra", "source_pdf", "page_start", "page_end", "section", "ref_citation",
    "llm_model", "llm_version", "strategy", "template_version", "created_at", "updated_at", "core_concept", "longtext", "original_text", "my_notes",
)


def discover(spark: SparkSession, paths: list[str], pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """path, length, modificationTime of each matching file once, in order of path. Contents aren't read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern)
    return r.load(paths).select("path", "length", "modificationTime").distinct().orderBy("path")


def with_digest(spark: SparkSession, paths: list[str], pattern: str = "*") -> DataFrame:
    """path, sha256 of each file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(paths).select("path", F.sha2("content", 256).alias("sha256"))


def extract(spark: SparkSession, paths: list[str], extractor: Callable[[str, bytes], list[str]], pattern: str = "*.pdf", first: int = 1, last: int | None = None) -> DataFrame:
    """path, page_num (from 1), raw_text of each page by an extractor (path, bytes) -> texts of pages.

    A file that it can't read has no pages. The page range is cut before rows leave the worker.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(paths).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                try:
                    texts = extractor(path, content.as_py())
                except Exception:  # noqa: BLE001  one bad file must not end the scan
                    continue
                rows = [(i, t) for i, t in enumerate(texts, 1) if i >= first and (last is None or i <= last)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], names=["path", "page_num", "raw_text"])

    return files.mapInArrow(run, PAGES)


def metadata(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """path and the columns of ``METADATA`` for each file; ``found`` has those that an extractor gave, by path. The title is
    the file's stem where none was given, the others are empty."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    out = files.select("path")
    have = set()
    if found is not None:
        have = set(found.columns)
        out = out.join(found, "path", "left")
    given = lambda c, other: F.coalesce(F.col(c), other) if c in have else other
    return out.select("path", *[given(c, stem if c == "title" else F.lit("")).alias(c) for c in METADATA])


def with_ordinals(rows: DataFrame, name: str = "card_ord") -> DataFrame:
    """Adds each row's place, 0, 1, ..., in the files that ``rows`` is read from: files in order of their path, the parts that
    a large file is read in by where they begin, rows as they stand.

    ``rows`` has to be a file source as read. Rows of a part have rising ids, so one pass that counts each part and finds
    its least id gives every part's first place; only one row for each part of a file moves.
    """
    seen = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_begin"), F.monotonically_increasing_id().alias("_row"))
    parts = seen.groupBy("_file", "_begin").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_file", "_begin")) - F.col("_n")
    parts = parts.select("_file", "_begin", (before - F.col("_first")).alias("_shift"))
    return seen.join(parts, ["_file", "_begin"]).select(*[F.col(c) for c in rows.columns], (F.col("_row") + F.col("_shift")).alias(name))


def cards_csv(spark: SparkSession, path: str) -> DataFrame:
    """A card table as written: all text, with tags and media as lists and ``card_ord``, the row's place in the saved order
    from 0; empty cells are null."""
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path, schema=None, inferSchema=False)
    header = with_ordinals(header)
    lists = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ";"), strip), lambda t: t != "")
    return header.withColumns({c: lists(c) for c in ("tags", "media") if c in header.columns})


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON from a path; no rows where nothing is there."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.option("multiLine", True).schema(T._parse_datatype_string(schema)).json(path)


def vector_index(spark: SparkSession, path: str) -> DataFrame:
    """A saved index of vectors; no rows where nothing is there."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        return spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    return spark.read.parquet(path)


def dedup_index(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, "content_hash string")
