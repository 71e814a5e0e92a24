"""Cards: from model responses to checked, reviewed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import preview, strip

CLOZE = r"\{\{c[0-9]+::[^}]+\}\}"
CLOZE_INNER = r"\{\{c[0-9]+::(.*?)\}\}"
#: Words that point to something to look at, and those of them that suffice without an image.
VISUAL = ("figure", "fig.", "table", "chart", "graph", "diagram", "image", "picture", "plot", "illustration", "exhibit")
NAMED = ("figure", "table", "chart", "graph")
STRATEGIES = {
    "key_points": ("Basic", "Key Point", "key-points"),
    "cloze_definitions": ("Cloze", "Definition", "cloze-definitions"),
    "figure_based": ("Basic", "Visual Content", "figure-based"),
}


def difficulty(x: Column) -> Column:
    return F.when(x.isin("easy", "medium", "hard"), x).otherwise("medium")


def tag_list(text: Column) -> Column:
    """Tags from a text with semicolons; nothing for null or empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), strip), lambda t: t != "")


def normal_tags(tags: Column, own: Column | str) -> Column:
    """The strategy's tag, then the others stripped and in lower case, each once, in order."""
    own = F.lit(own) if isinstance(own, str) else own
    more = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(strip(t))), lambda t: t != "")
    return F.array_distinct(F.concat(F.array(own), more))


def cloze_count(x: Column) -> Column:
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit(CLOZE))


def cloze_ok(x: Column, most: int = 3) -> Column:
    return cloze_count(x).between(1, most)


def without_cloze(x: Column) -> Column:
    return F.regexp_replace(x, CLOZE_INNER, "$1")


def parse_responses(responses: DataFrame) -> DataFrame:
    """Cards of model responses: doc_id, chunk_index, start_page, strategy, content -> one row for each card.

    The content has to be a JSON object; without ``cards`` it has none. A response with any card that lacks its
    required texts (front and back, or a cloze text with one to three marks) as strings gives no cards at all.
    """
    v = responses.withColumn("v", F.try_parse_json("content")).where(F.schema_of_variant("v").startswith("OBJECT"))
    v = v.withColumn("cards", F.try_variant_get("v", "$.cards", "array<variant>")).where("cards is not null")

    def text(c: Column, key: str) -> Column:
        """A JSON string as it is; anything else is null."""
        part = F.try_variant_get(c, f"$.{key}", "variant")
        return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(c, f"$.{key}", "string"))

    full = lambda x: F.coalesce(strip(x) != "", F.lit(False))
    is_cloze = F.col("strategy") == "cloze_definitions"
    ok = F.forall("cards", lambda c: F.when(is_cloze, full(text(c, "cloze_text")) & cloze_ok(text(c, "cloze_text"))).otherwise(full(text(c, "front")) & full(text(c, "back"))))
    rows = v.where(ok).select("doc_id", "chunk_index", "start_page", "strategy", F.posexplode("cards").alias("card_no", "c"))
    c = F.col("c")
    pick = lambda k: F.coalesce(*[F.when(F.col("strategy") == s, F.lit(x[k])) for s, x in STRATEGIES.items()])
    tags = F.coalesce(F.try_variant_get(c, "$.tags", "array<string>"), tag_list(text(c, "tags")))
    return rows.select(
        "doc_id", "chunk_index", "strategy", "card_no", pick(0).alias("note_type"),
        F.coalesce(text(c, "page_citation"), F.concat(F.lit("p. "), F.col("start_page").cast("string"))).alias("page_citation"),
        F.coalesce(text(c, "core_concept"), pick(1)).alias("core_concept"), difficulty(text(c, "difficulty")).alias("difficulty"), normal_tags(tags, pick(2)).alias("tags"),
        *[strip(F.coalesce(text(c, k), F.lit(""))).alias(k) for k in ("front", "back", "cloze_text", "extra")],
    )


def with_provenance(cards: DataFrame, chunks: DataFrame, model: str, template_version: str = "1.0") -> DataFrame:
    """Adds source_pdf, page_start, page_end, section, ref_citation, llm_model, template_version and original_text."""
    c = chunks.select("doc_id", "chunk_index", F.col("start_page").alias("page_start"), F.col("end_page").alias("page_end"), "section", "source_pdf", preview(F.col("text"), 500).alias("original_text"))
    out = cards.join(c, ["doc_id", "chunk_index"])
    return out.withColumns({"ref_citation": F.concat(F.lit("p. "), F.col("page_start").cast("string")), "llm_model": F.lit(model), "template_version": F.lit(template_version)})


def quotes(*parts: Column) -> Column:
    """Every double-quoted stretch of the parts."""
    whole = F.concat(*[F.concat(F.coalesce(p, F.lit("")), F.lit(" ")) for p in parts])
    return F.regexp_extract_all(whole, F.lit('"([^"]*)"'), F.lit(1))


def verified(cards: DataFrame, chunks: DataFrame, citations: bool = True, quoted: bool = True, drop: bool = True) -> DataFrame:
    """Cards with ``valid``: both citations present, and every quote of more than ten characters found in the chunk.

    ``drop`` leaves the others out. ``cards``: doc_id, chunk_index, front, back, cloze_text, extra, page_citation,
    ref_citation.
    """
    c = chunks.select("doc_id", "chunk_index", F.lower("text").alias("_chunk"))
    has = lambda n: F.coalesce(strip(F.col(n)) != "", F.lit(False))
    ok = F.lit(True)
    if citations:
        ok = ok & has("page_citation") & has("ref_citation")
    if quoted:
        ok = ok & ~F.exists(quotes(*map(F.col, ("front", "back", "cloze_text", "extra"))), lambda q: (F.length(q) > 10) & ~F.contains(F.col("_chunk"), F.lower(q)))
    out = cards.join(c, ["doc_id", "chunk_index"]).withColumn("valid", F.coalesce(ok, F.lit(False))).drop("_chunk")
    return out.where("valid") if drop else out


def figure_chunks(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """Chunks that speak of something visual and have an image on their pages, or name a figure, table, chart or graph."""
    low = F.lower("text")
    any_of = lambda ws: F.greatest(*[F.contains(low, F.lit(w)) for w in ws])
    i = images.select(F.col("doc_id").alias("_d"), F.col("page_num").alias("_p")).distinct()
    on_pages = (F.col("doc_id") == F.col("_d")) & F.col("_p").between(F.col("start_page"), F.col("end_page"))
    near = chunks.where(any_of(VISUAL)).join(i, on_pages, "left_semi")
    alone = chunks.where(any_of(NAMED)).join(i, on_pages, "left_anti")
    return near.unionByName(alone)


def reviewed(cards: DataFrame, reviews: DataFrame, least: float = 7.0, allow_edits: bool = True) -> DataFrame:
    """Cards with a score of at least ``least``, with the reviewer's edits.

    ``reviews``: card_ord, score, issues, edit_front, edit_back. A card without a review stays as it is; a review
    without a score counts as 5. Edits are taken as they stand, empty ones too; null is no edit. An edited front is the
    front of every card, and the cloze text of cloze cards as well.
    """
    r = reviews.select("card_ord", F.coalesce("score", F.lit(5.0)).alias("review_score"), "issues", F.col("edit_front").alias("_front"), F.col("edit_back").alias("_back"), F.lit(True).alias("_r"))
    out = cards.join(r, "card_ord", "left").where(F.col("_r").isNull() | (F.col("review_score") >= least))
    front, back = [F.when(F.lit(allow_edits), F.col(c)) for c in ("_front", "_back")]
    return out.select(
        *[c for c in cards.columns if c not in ("front", "back", "cloze_text")],
        F.coalesce(front, "front").alias("front"), F.coalesce(back, "back").alias("back"),
        F.when((F.col("note_type") == "Cloze") & front.isNotNull(), front).otherwise(F.col("cloze_text")).alias("cloze_text"),
        "review_score", F.col("issues").alias("review_issues"), (front.isNotNull() | back.isNotNull()).alias("review_edited"),
    )


def of_quality(cards: DataFrame, least: dict[str, float | None]) -> DataFrame:
    """Cards whose review score reaches their strategy's least; cards without a score, and strategies without one, stay."""
    floor = F.coalesce(*[F.when(F.col("strategy") == s, F.lit(float(x))) for s, x in least.items() if x is not None], F.lit(None).cast("double"))
    return cards.where(F.coalesce(F.col("review_score") >= floor, F.lit(True)))


def mock_responses(chunks: DataFrame, strategy: str = "key_points", most: int = 2) -> DataFrame:
    """A deterministic stand-in for a model in tests and dry runs, never used unless given: one card for each of the first lines of a chunk, as JSON."""
    lines = F.slice(F.filter(F.split("text", "\n"), lambda x: strip(x) != ""), 1, most)
    if STRATEGIES[strategy][0] == "Cloze":
        one = lambda x: F.struct(F.concat(F.lit("{{c1::"), F.substring_index(x, " ", 1), F.lit("}} is defined.")).alias("cloze_text"), x.alias("extra"))
    else:
        one = lambda x: F.struct(F.concat(F.lit("What about "), F.left(x, F.lit(20)), F.lit("?")).alias("front"), x.alias("back"))
    return chunks.select("doc_id", "chunk_index", "start_page", F.lit(strategy).alias("strategy"), F.to_json(F.struct(F.transform(lines, one).alias("cards"))).alias("content"))


def finalised(cards: DataFrame, deck: str, now: Column | None = None) -> DataFrame:
    """Adds deck, media, longtext, my_notes and both timestamps."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss") if now is None else now
    return cards.withColumns({"deck": F.lit(deck), "media": F.array().cast("array<string>"), "longtext": F.lit(""), "my_notes": F.lit(""), "created_at": now, "updated_at": now})
