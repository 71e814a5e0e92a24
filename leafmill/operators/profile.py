"""Document profiles: what a first and the last pages tell, and the settings that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A boundary that Java's and other engines' regular expressions see alike in accented text.
EDGE, AFTER = "(^|[^A-Za-z0-9_À-ÿ])", "([^A-Za-z0-9_À-ÿ]|$)"
CHAPTER = rf"(?im){EDGE}chapter\s+([0-9]+|[ivxlcdm]+){AFTER}|^\s*[0-9]+\.\s+[A-Z]"
ABSTRACT = rf"(?i){EDGE}(abstract|summary){AFTER}"
REFERENCES = rf"(?i){EDGE}(references|bibliography|works cited){AFTER}"
DOI = rf"(?i){EDGE}doi:\s*10\.[0-9]{{4,}}/[^\s]+"


def features(pages: DataFrame, toc: DataFrame | None = None) -> DataFrame:
    """doc_id, page_count, toc_present, chapters_detected, abstract_present, references_present, two_column_layout,
    has_doi, doc_type. The first page and the last five are looked at; ``toc``: doc_id of documents with an outline."""
    first, t = F.col("page_num") == 1, F.coalesce("raw_text", F.lit(""))
    # texts are looked at where they are; only what was found is shuffled
    flags = pages.select("doc_id", "page_num", *[(first & t.rlike(p)).alias(n) for n, p in (("chapters_detected", CHAPTER), ("abstract_present", ABSTRACT), ("has_doi", DOI))], F.when(t.rlike(REFERENCES), F.col("page_num")).alias("_refs"))
    f = flags.groupBy("doc_id").agg(F.max("page_num").cast("int").alias("page_count"), *[F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in ("chapters_detected", "abstract_present", "has_doi")], F.max("_refs").alias("_refs"))
    f = f.withColumn("references_present", F.coalesce(F.col("_refs") > F.col("page_count") - 5, F.lit(False))).drop("_refs")
    if toc is not None:
        f = f.join(toc.select("doc_id", F.lit(True).alias("_toc")).distinct(), "doc_id", "left").withColumn("toc_present", F.coalesce("_toc", F.lit(False))).drop("_toc")
    else:
        f = f.withColumn("toc_present", F.lit(False))
    return f.withColumn("two_column_layout", F.lit(False)).withColumn("doc_type", doc_type())


def doc_type() -> Column:
    n = lambda c, k: F.col(c).cast("int") * k
    paper = n("abstract_present", 2) + n("references_present", 2) + n("has_doi", 3) + F.col("page_count").between(5, 30).cast("int")
    book = n("chapters_detected", 3) + n("toc_present", 2) + (F.col("page_count") > 50).cast("int") * 2
    return F.when(paper >= 4, "research_paper").when(book >= 4, "textbook").otherwise("unknown")


def defaults(profiles: DataFrame) -> DataFrame:
    """doc_id, mode, tokens_per_chunk, strategies, respect_page_bounds for each profile."""
    kind = F.col("doc_type")
    size = F.when(kind == "research_paper", 1500).when(kind == "textbook", 2500).otherwise(2000)
    return profiles.select(
        "doc_id", F.when(kind == "research_paper", "sections").when(kind == "textbook", "smart").otherwise("pages").alias("mode"),
        F.when(F.col("page_count") > 100, F.greatest(size, F.lit(3000))).otherwise(size).alias("tokens_per_chunk"),
        F.when(kind == "research_paper", F.array(F.lit("key_points"), F.lit("cloze_definitions"))).when(kind == "textbook", F.array(F.lit("key_points"), F.lit("figure_based"))).otherwise(F.array(F.lit("key_points"))).alias("strategies"),
        (~F.col("two_column_layout")).alias("respect_page_bounds"),
    )
