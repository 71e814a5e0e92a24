"""Chunks of documents that are larger than a row: the same rows as ``chunking`` gives, without gathering a document.

Where a chunk begins depends on lengths alone. So only (document, page, length) is brought together and folded in order,
as a stream that holds one open chunk; texts then meet by chunk, however many chunks a document has and wherever its
pages lie. Sections meet their pages one by one. Only an overlap of words needs texts in order; they stream too.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import strip, tokens
from leafmill.operators import chunking
from leafmill.operators.chunking import _counts, packed_texts, paragraphs, split_text
from leafmill.plans.ship import ship
from leafmill.plans.store import settle

LAST = 2**31 - 1


def _met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables' columns where all keys agree; a null agrees with a null, as in the grouping that this stands for."""
    b = b.withColumnsRenamed({k: f"_b_{k}" for k in keys})
    return a.join(b, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys))).drop(*[f"_b_{k}" for k in keys])


def run_starts(lengths: DataFrame, budget: int, joint: int = 2) -> DataFrame:
    """doc_id, page_num, first: the page with which each page's run begins. ``lengths``: doc_id, page_num, n, one row a page.

    Rows come sorted; the fold carries the open run from batch to batch, four numbers whatever the document's size.
    """
    ship(lengths.sparkSession)

    def fold(batches):
        doc = first = size = None
        begun = False
        for b in batches:
            begins = []
            for d, page, n in zip(*(b.column(c).to_pylist() for c in ("doc_id", "page_num", "n"))):
                same = begun and d == doc
                whole = size + joint + n if same else n
                if not same or whole // 4 > budget:
                    begun, doc, first, size = True, d, page, n
                else:
                    size = whole
                begins.append(first)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("page_num"), pa.array(begins, pa.int32())], names=["doc_id", "page_num", "first"])

    kinds = dict(lengths.dtypes)
    dealt = lengths.select("doc_id", "page_num", "n").repartition("doc_id").sortWithinPartitions("doc_id", "page_num")
    return dealt.mapInArrow(fold, f"doc_id {kinds['doc_id']}, page_num int, first int")


def by_pages(pages: DataFrame, budget: int = 2000) -> DataFrame:
    """What ``chunking.by_pages`` gives. A page is the largest text that a row has to hold."""
    p = pages.select("doc_id", F.col("page_num").cast("int").alias("page_num"), strip(F.coalesce("raw_text", F.lit(""))).alias("t")).where("t <> ''")
    fits = tokens(F.col("t")) <= budget
    small = p.where(fits)
    begins = run_starts(small.select("doc_id", "page_num", F.length("t").alias("n")), budget)
    runs = _met(small, begins, ["doc_id", "page_num"]).groupBy("doc_id", "first").agg(F.array_sort(F.collect_list(F.struct("page_num", "t"))).alias("u"))
    runs = runs.select("doc_id", F.lit(1).alias("k"), F.col("first").alias("at"), F.lit(0).alias("j"), F.array_join(F.transform("u", lambda x: x["t"]), "\n\n").alias("text"), F.col("first").alias("start_page"), F.element_at("u", -1)["page_num"].alias("end_page"))
    cut = p.where(~fits).select("doc_id", "page_num", F.posexplode(split_text(F.col("t"), budget, budget)).alias("j", "text"))
    cut = cut.select("doc_id", F.lit(0).alias("k"), F.col("page_num").alias("at"), "j", "text", F.col("page_num").alias("start_page"), F.col("page_num").alias("end_page"))
    both = settle(runs.unionByName(cut))
    # a run stands where the next one begins, pieces of a large page where that page is
    after = F.coalesce(F.lead("at").over(Window.partitionBy("doc_id", "k").orderBy("at", "j")), F.lit(LAST))
    placed = both.select("doc_id", "k", "at", "j", F.when(F.col("k") == 1, after).otherwise(F.col("at")).alias("_at"))
    w = Window.partitionBy("doc_id")
    placed = placed.withColumn("chunk_index", F.row_number().over(w.orderBy("_at", "k", "j")) - 1).withColumn("total_chunks", F.count(F.lit(1)).over(w).cast("int")).drop("_at")
    return _out(_met(both, placed, ["doc_id", "k", "at", "j"]))


def by_paragraphs(pages: DataFrame, budget: int = 2000, least: int = 100) -> DataFrame:
    """What ``chunking.by_paragraphs`` gives: a page is packed in its row, its document's last page comes from an aggregate."""
    p = pages.select("doc_id", F.col("page_num").cast("int").alias("page_num"), F.coalesce("raw_text", F.lit("")).alias("t"))
    last = p.groupBy("doc_id").agg(F.max("page_num").alias("_last"))
    packed = _met(p, last, ["doc_id"]).select("doc_id", "page_num", "_last", packed_texts(paragraphs(F.col("t"), budget), budget).alias("texts"))
    each = packed.select("doc_id", "page_num", "_last", F.size("texts").alias("n"), F.posexplode("texts").alias("j", "text"))
    kept: Column = (F.col("j") < F.col("n") - 1) | (F.col("page_num") == F.col("_last")) | (tokens(F.col("text")) >= least)
    out = settle(each.where(kept).select("doc_id", "page_num", "j", "text", F.col("page_num").alias("start_page"), F.col("page_num").alias("end_page")))
    w = Window.partitionBy("doc_id")
    places = out.select("doc_id", "page_num", "j").withColumn("chunk_index", F.row_number().over(w.orderBy("page_num", "j")) - 1).withColumn("total_chunks", F.count(F.lit(1)).over(w).cast("int"))
    return _out(_met(out, places, ["doc_id", "page_num", "j"]))


def by_sections(sections: DataFrame, pages: DataFrame, target: int = 4000, budget: int = 2000) -> DataFrame:
    """What ``chunking.by_sections`` gives. A section is the largest text that a row has to hold.

    A section is sent to each of its pages that exist, so a document's sections and pages are spread over all tasks."""
    p = pages.select("doc_id", F.col("page_num").cast("int").alias("page_num"), strip(F.coalesce("raw_text", F.lit(""))).alias("t")).where("t <> ''")
    bounds = p.groupBy("doc_id").agg(F.min("page_num").alias("lo"), F.max("page_num").alias("hi"))
    each = sections.groupBy("doc_id", F.struct("sec_no", "title", "start_page", "end_page").alias("s")).agg(F.count(F.lit(1)).alias("copies"))
    first, last = F.greatest("s.start_page", "lo"), F.least("s.end_page", "hi")
    # a null end covers nothing
    covers = each.join(bounds, "doc_id").where(F.col("s.start_page").isNotNull() & F.col("s.end_page").isNotNull() & (first <= last))
    covers = covers.select("doc_id", "s", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("page_num"))
    whole = covers.join(p, ["doc_id", "page_num"]).groupBy("doc_id", "s").agg(F.array_sort(F.collect_list(F.struct("page_num", "t"))).alias("u"))
    text = F.array_join(F.transform("u", lambda x: x["t"]), "\n\n")
    pieces = settle(whole.select("doc_id", "s", F.posexplode(split_text(text, target, budget)).alias("j", "text")))
    places = pieces.select("doc_id", "s", "j").join(each, ["doc_id", "s"]).select("doc_id", "s", "j", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    w = Window.partitionBy("doc_id")
    places = places.withColumn("chunk_index", F.row_number().over(w.orderBy("s", "copy", "j")) - 1).withColumn("total_chunks", F.count(F.lit(1)).over(w).cast("int"))
    out = pieces.join(places, ["doc_id", "s", "j"]).select("doc_id", "chunk_index", "total_chunks", "text", "s.start_page", "s.end_page", F.col("s.title").alias("section"))
    rest = by_pages(pages.join(sections.select("doc_id").distinct(), "doc_id", "left_anti"), budget).withColumn("section", F.lit(None).cast("string"))
    return _counts(out).unionByName(rest)


def overlapped(pages: DataFrame, budget: int, overlap: int) -> DataFrame:
    """doc_id, chunk_index, text, start_page, end_page, section: pages (doc_id, page_num, t, head) packed in order, with the last
    words of a full chunk before the next one, and a new chunk at each head. The open chunk is all that a task holds."""
    ship(pages.sparkSession)
    kinds = dict(pages.dtypes)
    names = ["doc_id", "chunk_index", "text", "start_page", "end_page", "section"]

    def tail(text: str) -> str:
        said = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
        n = overlap // 4
        return " ".join(said[-n:] if n else said)

    def fold(batches):
        begun, doc, text, first, last, section, number = False, None, "", None, None, None, 0
        done: list[list] = [[] for _ in names]
        kept, types = 0, None

        def closed():
            for column, x in zip(done, (doc, number, text, first, last, section)):
                column.append(x)

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, types)], names=names)

        for b in batches:
            types = [b.column("doc_id").type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            for d, page, t, head in zip(*(b.column(c) for c in ("doc_id", "page_num", "t", "head"))):
                d, page, t, head = d.as_py(), page.as_py(), t.as_py(), head.as_py()
                if not begun or d != doc:
                    if text:
                        closed()
                    begun, doc, text, section, number = True, d, "", None, 0
                grown = f"{text}\n\n{t}" if text else t
                headed = bool(text) and head is not None
                over = bool(text) and not headed and len(grown) // 4 > budget
                if headed or over:
                    closed()
                    kept += len(text)
                    number += 1
                if headed or over or not text:
                    first = page
                text = t if headed else (f"{tail(text)}\n\n{t}" if overlap > 0 else t) if over else grown
                section = head if headed or section is None else section
                last = page
                if kept > 4 << 20:
                    yield sent()
                    done, kept = [[] for _ in names], 0
        if text:
            closed()
        if types and done[0]:
            yield sent()

    dealt = pages.select("doc_id", "page_num", "t", "head").repartition("doc_id").sortWithinPartitions("doc_id", "page_num", "t", "head")
    return dealt.mapInArrow(fold, f"doc_id {kinds['doc_id']}, chunk_index int, text string, start_page int, end_page int, section string")


def smart(pages: DataFrame, headings: DataFrame, sections: DataFrame, budget: int = 2000, overlap: int = 200, target: int = 4000, paragraph: int | None = None) -> DataFrame:
    """What ``chunking.smart`` gives. A section, or a page with an open chunk, is the largest text that is held."""
    rich = settle(sections.groupBy("doc_id").count().where("count >= 3").select("doc_id"))
    first = by_sections(sections.join(rich, "doc_id", "left_semi"), pages.join(rich, "doc_id", "left_semi"), target, paragraph or budget)
    top = headings.where("level <= 2").groupBy("doc_id", F.col("page").alias("page_num")).agg(F.min_by("text", "ord").alias("head"))
    p = pages.join(rich, "doc_id", "left_anti").join(top, ["doc_id", "page_num"], "left")
    p = p.select("doc_id", F.col("page_num").cast("int").alias("page_num"), strip(F.coalesce("raw_text", F.lit(""))).alias("t"), "head").where("t <> ''")
    made = settle(overlapped(p, budget, overlap))
    count = made.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("total_chunks"))
    rest = _met(made, count, ["doc_id"]).withColumn("text", strip("text"))
    return first.unionByName(_counts(rest))


def chunk(mode: str, pages: DataFrame, headings: DataFrame | None = None, sections: DataFrame | None = None, budget: int = 2000, overlap: int = 200, least: int = 100, most: int = 4000, token_budget: int = 8000, trim: bool = True) -> DataFrame:
    """``chunking.chunk`` without gathering documents. Whole documents (``entire``) are rows by what they are."""
    if mode == "pages":
        return by_pages(pages, budget)
    if mode == "paragraphs":
        return by_paragraphs(pages, budget, least)
    if mode in ("sections", "smart", "figures", "highlights") and headings is not None and sections is not None:
        return by_sections(sections, pages, most, budget) if mode == "sections" else smart(pages, headings, sections, budget, overlap, most)
    return chunking.chunk(mode, pages, headings, sections, budget, overlap, least, most, token_budget, trim)


def _out(chunks: DataFrame) -> DataFrame:
    return _counts(chunks.select("doc_id", "chunk_index", "total_chunks", "text", "start_page", "end_page"))
