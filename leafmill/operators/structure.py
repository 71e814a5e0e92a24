"""Headings, sections and chapters from laid-out text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import strip

BOLD = 16


def blocks_to_lines(blocks: DataFrame) -> DataFrame:
    """doc_id, page_num, block_no, type, width, height, lines: text blocks with spans joined line by line, blank lines
    and empty text blocks left out, image blocks kept with their size, other blocks dropped.

    ``blocks``: doc_id, page_num, block_no, type (0 text, 1 image), width, height, lines array<array<string>> of spans.
    """
    lines = F.filter(F.transform(F.coalesce("lines", F.array().cast("array<array<string>>")), lambda s: strip(F.array_join(s, ""))), lambda x: x != "")
    out = blocks.where("type in (0, 1)").withColumn("lines", F.when(F.col("type") == 0, lines))
    return out.where((F.col("type") == 1) | (F.size("lines") > 0)).select("doc_id", "page_num", "block_no", F.when(F.col("type") == 0, "text").otherwise("image").alias("type"), "lines", "width", "height")


def heading_level(size: Column, bold: Column) -> Column:
    return F.when(size >= 18, 1).when(size >= 16, 2).when((size >= 14) | bold, 3).otherwise(4)


def headings(spans: DataFrame) -> DataFrame:
    """doc_id, ord, text, page, level, font_size, is_bold.

    ``spans``: doc_id, page_num, block_no, line_no, span_no, text, size, flags. A line is a heading when it is short,
    large or bold, has under 20 words and no full stop at its end.
    """
    lines = spans.groupBy("doc_id", "page_num", "block_no", "line_no").agg(
        F.array_sort(F.collect_list(F.struct("span_no", strip("text").alias("t")))).alias("u"), F.max("size").alias("font_size"), F.bool_or(F.col("flags").bitwiseAND(BOLD) != 0).alias("is_bold"),
    )
    lines = lines.withColumn("text", strip(F.array_join(F.transform("u", lambda x: x["t"]), " ")))
    short = (F.length("text") < 200) & ~F.col("text").endswith(".") & (F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) < 20)
    lines = lines.where((F.col("text") != "") & short & ((F.col("font_size") > 14) | F.col("is_bold")))
    ord_ = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "block_no", "line_no")) - 1
    return lines.select("doc_id", ord_.alias("ord"), "text", F.col("page_num").alias("page"), heading_level(F.col("font_size"), F.col("is_bold")).alias("level"), "font_size", "is_bold")


def sections(heads: DataFrame) -> DataFrame:
    """doc_id, sec_no, title, start_page, end_page: a heading of level 1 or 2 opens a section; its end is the page of the
    last deeper heading in it. Deeper headings before the first section belong to none."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    top = F.col("level") <= 2
    g = heads.withColumn("grp", F.sum(top.cast("int")).over(w)).where("grp > 0")
    g = g.groupBy("doc_id", "grp").agg(F.min_by("text", "ord").alias("title"), F.min_by("page", "ord").alias("start_page"), F.max_by("page", F.when(~top, F.col("ord"))).alias("deep"))
    return g.select("doc_id", (F.col("grp") - 1).cast("int").alias("sec_no"), "title", "start_page", F.coalesce("deep", "start_page").alias("end_page"))


def detected(spans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headings, sections and chapters of laid-out text."""
    heads = headings(spans)
    return heads, sections(heads), chapters(heads)


def chapters(heads: DataFrame) -> DataFrame:
    """doc_id, ord, title, page, level of headings that look like chapters."""
    low = F.lower("text")
    named = low.contains("chapter") | low.contains("part") | low.contains("section") | low.contains("unit")
    return heads.where((F.col("level") == 1) | named | F.left("text", F.lit(10)).rlike("[0-9]")).select("doc_id", "ord", F.col("text").alias("title"), "page", "level")


def text_hash(pages: DataFrame, first: int = 5) -> DataFrame:
    """doc_id, text_hash: 16 hex digits over the first pages' raw text."""
    w = Window.partitionBy("doc_id").orderBy("page_num")
    p = pages.select("doc_id", "page_num", F.coalesce("raw_text", F.lit("")).alias("t"), F.row_number().over(w).alias("k")).where(F.col("k") <= first)
    p = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "t"))).alias("u"))
    return p.select("doc_id", F.left(F.sha2(F.array_join(F.transform("u", lambda x: x["t"]), ""), 256), F.lit(16)).alias("text_hash"))


def image_names(images: DataFrame) -> DataFrame:
    """Adds filename to images of at least 100 x 100 pixels: page, number and content digest."""
    big = images.where("width >= 100 and height >= 100")
    return big.withColumn("filename", F.format_string("img_p%d_%d_%s.png", "page_num", "image_index", F.left(F.md5("content"), F.lit(12))))
