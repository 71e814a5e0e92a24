"""From pages to a checked, deduplicated card table, as one chain of DataFrames."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators import cards as cd
from leafmill.operators import chunking, dedup, generation, identity, large
from leafmill.plans.config import Config
from leafmill.plans.store import settle, stored
from leafmill.plans.templates import Prompt, render, system_prompt
from leafmill.sources.sinks import save_index

Generator = Callable[[DataFrame, str], DataFrame]
_registry: dict[str, Generator] = {}


def register(strategy: str, generator: Generator) -> None:
    """A strategy's way from chunks to responses (doc_id, chunk_index, start_page, strategy, content)."""
    _registry[strategy] = generator


def strategies() -> list[str]:
    return sorted({*_registry, *cd.STRATEGIES})


def prompted(chunks: DataFrame, strategy: str, prompt: Prompt, most: int = 5, **more: Column | str | int) -> DataFrame:
    """doc_id, chunk_index, start_page, strategy, prompt, system: what a model is asked about each chunk.

    Templates know chunk and chunk_text, section, page_start, page_end, pdf_title (the file's name), author, strategy and
    max_cards, the prompt's own parameters, and what is given besides.
    """
    has = lambda c, other: F.col(c) if c in chunks.columns else F.lit(other)
    known = {
        "chunk": F.col("text"), "chunk_text": F.col("text"), "section": has("section", None), "page_start": F.col("start_page"), "page_end": has("end_page", None),
        "pdf_title": F.coalesce(has("pdf_title", None), has("source_pdf", None), F.lit("Unknown")), "author": F.coalesce(has("author", ""), F.lit("")), "strategy": strategy, "max_cards": most,
    }
    return chunks.select("doc_id", "chunk_index", "start_page", F.lit(strategy).alias("strategy"), render(prompt, **{**known, **more}).alias("prompt"), F.lit(system_prompt(strategy)).alias("system"))


class Asking:
    """A generator that asks a model about each chunk: prompts rendered in the JVM, answers that ``cache`` has taken from
    there, the others asked for once for each distinct prompt, kept in it, and counted in ``usage``.

    ``cache`` and ``usage`` are folders of Parquet tables, or None. A call that fails gives its chunk no cards and is not kept.
    """

    def __init__(self, model: generation.Model, prompts: dict[str, Prompt], name: str = "", params: str = "", cache: str | None = None, usage: str | None = None, retries: int = 3, most: int = 5, wait: Callable[[float], None] = time.sleep):
        self.model, self.prompts, self.name, self.params, self.cache, self.usage, self.retries, self.most, self.wait = model, prompts, name, params, cache, usage, retries, most, wait

    def __call__(self, chunks: DataFrame, strategy: str) -> DataFrame:
        if strategy not in self.prompts:
            raise ValueError(f"no prompt {strategy!r}")
        spark = chunks.sparkSession
        asked = prompted(chunks, strategy, self.prompts[strategy], self.most)
        asked = settle(asked.withColumn("key", generation.prompt_key(F.concat_ws("\x1e", "system", "prompt"), F.lit(self.name), F.lit(self.params))))
        kept = stored(spark, self.cache, "key string, content string")
        hits, todo = generation.split_cached(asked, kept)
        new = settle(generation.responses(todo, self.model, True, self.retries, self.wait))
        if self.cache:
            new.where("content is not null").select("key", "content").write.mode("append").parquet(self.cache)
        if self.usage:
            calls = new.select(F.lit(strategy).alias("strategy"), F.lit(self.name).alias("model"), "tokens_in", "tokens_out", F.lit(False).alias("cached"), "attempts", "error")
            found = hits.select(F.lit(strategy).alias("strategy"), F.lit(self.name).alias("model"), *[F.lit(0).cast("bigint").alias(c) for c in ("tokens_in", "tokens_out")], F.lit(True).alias("cached"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))
            calls.unionByName(found).write.mode("append").parquet(self.usage)
        told = hits.select("doc_id", "chunk_index", "start_page", "strategy", "content")
        fresh = asked.join(new.where("content is not null").select("key", "content"), "key").select(told.columns)
        return told.unionByName(fresh)


def responses(chunks: DataFrame, strategy: str, images: DataFrame | None = None, ask: Generator | None = None) -> DataFrame:
    """By the strategy's registered generator, else by ``ask``; without either there is none to make cards, an error."""
    if strategy == "figure_based":
        # without images only what names a figure stays
        none = chunks.sparkSession.createDataFrame([], "doc_id bigint, page_num int")
        chunks = cd.figure_chunks(chunks, none if images is None else images)
    if (made := _registry.get(strategy, ask)) is None:
        raise ValueError(f"no generator for {strategy!r}: register one or give a model to ask")
    return made(chunks, strategy)


def build(
    pages: DataFrame, config: Config | None = None, headings: DataFrame | None = None, sections: DataFrame | None = None, images: DataFrame | None = None,
    reviews: Callable[[DataFrame], DataFrame] | None = None, index: DataFrame | None = None, known_ids: DataFrame | None = None, paths: DataFrame | None = None, now: Column | None = None,
    ask: Generator | None = None, new_index: str | None = None, large_documents: bool = False,
) -> DataFrame:
    """All cards of all documents.

    ``large_documents``: cut documents that no row holds (see ``operators.large``), the same chunks at more shuffles.
    ``paths``: doc_id, source_pdf. ``ask``: what strategies without a registered generator are asked of, such as ``Asking``.
    ``new_index``: where the index with this run's cards is written (as a whole; not the folder ``index`` is read from). Generated responses are stored before anything reads them twice. Cards are numbered by
    (document, chunk, strategy, place); that order decides which of two near duplicates stays.
    """
    c = config or Config()
    p, g = c.pipeline, c.generate
    k, dup, hall = p.ingestion.chunking, p.deduplication, p.hallucination
    mode = k.mode
    if mode in ("sections", "smart", "figures", "highlights") and (headings is None or sections is None):
        warnings.warn(f"nothing is known of the documents' structure, so they are cut by pages instead of {mode!r}", UserWarning, stacklevel=2)
        mode = "pages"
    chunks = (large if large_documents else chunking).chunk(mode, pages, headings, sections, k.tokens_per_chunk, k.overlap_tokens, k.min_chunk_tokens, k.max_chunk_tokens, k.token_budget, k.enable_trimming)
    if "section" not in chunks.columns:
        chunks = chunks.withColumn("section", F.lit(None).cast("string"))
    name = F.col("source_pdf") if paths is not None else F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    chunks = (chunks.join(paths, "doc_id", "left") if paths is not None else chunks).withColumn("source_pdf", name)
    out = None
    for number, strategy in enumerate(g.strategies.enabled()):
        got = cd.parse_responses(settle(responses(chunks, strategy, images, ask))).withColumn("_s", F.lit(number))
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no strategy is enabled")
    out = cd.with_provenance(out, chunks, p.llm.model)
    if hall.require_citations or hall.verify_quotes:
        out = cd.verified(out, chunks, hall.require_citations, hall.verify_quotes, hall.drop_on_failure)
    out = dedup.first_of(out.withColumn("card_ord", ordinal()), F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), "strategy", F.lower("front"), cd.without_cloze(F.col("cloze_text"))))
    if p.review.enabled and reviews is not None:
        out = cd.reviewed(out, settle(reviews(out)), p.review.min_score, p.review.allow_edits)
    if any(getattr(g.strategies, s).min_score is not None for s in g.strategies.enabled()) and "review_score" in out.columns:
        out = cd.of_quality(out, {s: getattr(g.strategies, s).min_score for s in g.strategies.enabled()})
    out = settle(out)
    if dup.enabled:
        vectors = dup.embedding_threshold if "embedding" in out.columns else 0.0
        if dup.scope_within_run:
            out = dedup.within_run(out, dup.fuzzy_threshold, vectors, dup.policy.upper())
        if dup.scope_persistent and index is not None:
            out, grown = dedup.against_index(out, index)
            out = settle(out)
            if new_index:
                save_index(grown, new_index)
    if g.ids.strategy == "persistent":
        known = known_ids if known_ids is not None else out.sparkSession.createDataFrame([], "key string, id string")
        out = identity.persistent_ids(out, known, g.ids.salt)
    else:
        out = identity.content_ids(out, g.ids.salt)
    return cd.finalised(out, g.anki.deck_name, now).drop("_s", "valid")


def ordinal() -> Column:
    """One number that sorts like (doc_id, chunk_index, strategy, card_no): 19, 9, 2 and 8 digits, so no two rows share it."""
    digits = lambda n: F.lit("1" + "0" * n).cast(f"decimal({n + 1},0)")
    low = F.col("chunk_index").cast("decimal(9,0)") * digits(10) + (F.col("_s") * 10**8 + F.col("card_no")).cast("decimal(10,0)")
    return (F.col("doc_id").cast("decimal(19,0)") * digits(19) + low).cast("decimal(38,0)")
