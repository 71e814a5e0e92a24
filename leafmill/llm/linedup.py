"""Repeated passages of three lines, in built-in functions only.

Every window of three consecutive lines of a document is hashed (128 bits). A window that occurs more than once in the
corpus keeps its first occurrence, by (doc_id, position); every later occurrence is covered, and a line goes if any
covered window holds it. Documents of one or two lines have no window and stay as they are.

Scale: one aggregate over the windows (with partial sums, so a frequent window sends one row from each task), whose
repeated keys are stored; the windows are then joined with them. When the keys are few they are broadcast; else both
sides are shuffled and a hot key can be split by adaptive skew handling. Texts are shuffled once, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import BROADCAST_ROWS, broadcast_if_small, stage

WINDOW = 3


def _window_hashes(lines: Column, width: int) -> Column:
    """(pos, h1, h2) of each window; lines are zipped with themselves shifted, so each is split once."""
    zipped = F.arrays_zip(*[F.slice(lines, k + 1, F.greatest(F.size(lines) - k, F.lit(0))).alias(f"l{k}") for k in range(width)])
    zipped = F.slice(zipped, F.lit(1), F.greatest(F.size(lines) - (width - 1), F.lit(0)))
    return F.transform(zipped, lambda z, i: F.struct(
        i.alias("pos"),
        F.xxhash64(*[z[f"l{k}"] for k in range(width)]).alias("h1"),
        F.xxhash64(F.lit(1), *[z[f"l{k}"] for k in range(width)]).alias("h2"),
    ))


def windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, text_id (a hash of the text), pos, h1, h2."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_id"), F.split("text", "\n").alias("lines"))
    return lines.select("doc_id", "text_id", F.explode(_window_hashes(F.col("lines"), width)).alias("w")).select("doc_id", "text_id", "w.pos", "w.h1", "w.h2")


def covered(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, text_id, gone: the positions (from 0) of the lines that later occurrences cover."""
    place = F.struct("doc_id", "text_id", "pos")
    keys = windows(docs, width).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    keys = stage(keys.where("n > 1").select("h1", "h2", "first"), "windows")
    later = windows(docs, width).join(broadcast_if_small(keys, keys.count(), BROADCAST_ROWS), ["h1", "h2"])
    later = later.where(place > F.col("first"))
    # covered positions merge as a set
    return later.groupBy("doc_id", "text_id").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("pos", F.col("pos") + (width - 1))))).alias("gone"))


def dedup_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """The input rows with ``text`` without covered lines, and with ``n_lines``, ``n_removed``.

    Null texts stay null (0 lines); empty texts stay empty (1 line). A document that loses all its lines has the empty
    text. Lines are compared byte by byte as they stand. Rows that repeat a doc_id and text count as one document;
    different texts under one doc_id are documents of their own, the one with the smaller hash first. A null doc_id is never
    joined, so such rows keep all lines. An empty table gives none. Other columns pass through; n_lines and n_removed of the
    input are replaced.
    """
    known = docs.where("text is not null and doc_id is not null").select("doc_id", "text")
    gone = covered(known, width).select(F.col("doc_id").alias("_of"), F.col("text_id").alias("_hash"), "gone")
    # the input's columns travel as one, so no name of theirs meets one of these
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.split("text", "\n").alias("lines"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    rows = rows.join(gone, (F.col("id") == F.col("_of")) & (F.col("hash") == F.col("_hash")), "left")
    kept = F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"))
    rows = rows.select("row", "lines", kept.alias("kept"))
    text = F.when(F.col("kept").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n"))
    n = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    removed = F.when(F.col("kept").isNull(), 0).otherwise(n - F.size("kept"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")], n.alias("n_lines"), removed.alias("n_removed"))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text_md5 of what stays, for each row; nulls, repeats and empty tables as in ``dedup_lines``."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.col("n_removed").cast("bigint").alias("n_removed"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


LINE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i AS pos, list_slice(l, i + 1, i + 3) AS k FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS i FROM d WHERE len(l) >= 3)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM w),
g AS (SELECT DISTINCT doc_id, pos + o.o AS pos FROM r, (SELECT unnest([0, 1, 2]) AS o) o WHERE nth > 1),
l AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM d),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
      FROM (SELECT l.doc_id, l.line, l.pos, g.pos IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos) l GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, md5(coalesce(text, '')) AS text_md5 FROM k
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
