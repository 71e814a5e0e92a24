"""Decks and notes from card rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import strip, title_case

STRUCTURES = ("flat", "predefined", "by_chapter", "by_theme")


#: The fields of the note types that cards are made with, in order.
NOTE_FIELDS = {"Basic": ("Front", "Back", "Source", "Page", "Section", "Tags", "Extra"), "Cloze": ("Text", "Extra", "Source", "Page", "Section", "Tags")}
STYLE = ".card { font-family: sans-serif; font-size: 16px; padding: 1em; } .source { color: #777; font-size: 12px; } .cloze { font-weight: bold; }"


def note_types(prefix: str = "Leafmill") -> list[dict]:
    """The default note types: name, model_id, kind, fields, templates, css. The id is a hash of name and fields, so it is the
    same in every run."""
    out = []
    for kind, fields in NOTE_FIELDS.items():
        name = f"{prefix} {kind}"
        asked = "{{Front}}" if kind == "Basic" else "{{cloze:Text}}"
        below = '{{#Section}}<div class="source">{{Section}}</div>{{/Section}}<div class="source">{{Source}} {{Page}}</div>'
        shown = f"{asked}<hr>{{{{Back}}}}" if kind == "Basic" else asked
        number = int.from_bytes(hashlib.sha256("\x1f".join([name, *fields]).encode()).digest()[:4], "big") % (1 << 30) + (1 << 30)
        template = {"name": "Card 1", "qfmt": asked + below, "afmt": shown + "{{#Extra}}<div>{{Extra}}</div>{{/Extra}}" + below}
        out.append({"name": name, "model_id": number, "kind": kind, "fields": list(fields), "templates": [template], "css": STYLE})
    return out


def math_content(text: Column) -> Column:
    """Formulas stay as they are: both delimiters are the deck's own."""
    return text


def deck_of(name: str, structure: str = "flat") -> Column:
    """The deck of a row: its section's or its strategy's, under the main deck; the main deck where it has none."""
    part = {"by_chapter": F.col("section"), "by_theme": title_case(F.replace(F.col("strategy"), F.lit("_"), F.lit(" ")))}.get(structure)
    if part is None:
        return F.lit(name)
    return F.when(F.coalesce(strip(part) != "", F.lit(False)), F.concat(F.lit(f"{name}::"), part)).otherwise(name)


def decks(cards: DataFrame, name: str, structure: str = "flat") -> DataFrame:
    """deck, n_cards of every deck that cards fall into, and of the main one."""
    got = cards.groupBy(deck_of(name, structure).alias("deck")).agg(F.count(F.lit(1)).alias("n_cards"))
    main = cards.sparkSession.range(1).select(F.lit(name).alias("deck"), F.lit(0).cast("bigint").alias("n_cards"))
    return got.unionByName(main).groupBy("deck").agg(F.sum("n_cards").alias("n_cards"))


def source_info() -> Column:
    """struct(source, page, section): the file's name (Unknown where there is none), its page or pages, its section. Pages
    may be numbers or texts; where no first page is known the range is empty."""
    path = F.coalesce(F.col("source_pdf"), F.lit(""))
    name = F.when(path == "", "Unknown").otherwise(F.regexp_extract(path, "([^/]*)/*$", 1))
    a, b = [F.nullif(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("0")) for c in ("page_start", "page_end")]
    page = F.when(a.isNull(), "").when(b.isNull() | (a == b), F.concat(F.lit("p. "), a)).otherwise(F.concat(F.lit("pp. "), a, F.lit("-"), b))
    return F.struct(name.alias("source"), page.alias("page"), F.coalesce(F.col("section"), F.lit("")).alias("section"))


def deck_tags(most: int = 20) -> Column:
    """The row's tags, its strategy and its type: stripped, spaces to underscores, lower case, each once, the first so many."""
    own = F.array(F.when(F.coalesce(F.col("strategy") != "", F.lit(False)), F.concat(F.lit("strategy:"), F.col("strategy"))), F.when(F.coalesce(F.col("note_type") != "", F.lit(False)), F.concat(F.lit("type:"), F.col("note_type"))))
    all_ = F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.filter(own, lambda t: t.isNotNull()))
    return F.slice(F.array_distinct(F.filter(F.transform(all_, lambda t: F.lower(F.replace(strip(t), F.lit(" "), F.lit("_")))), lambda t: t != "")), 1, most)


def notes(cards: DataFrame, name: str, structure: str = "flat") -> DataFrame:
    """guid, deck, model, fields array<string>, tags. The fields are those of ``NOTE_FIELDS``, in its order. Rows of other
    types than Basic and Cloze make no note."""
    rows = cards.where(F.col("note_type").isin("Basic", "Cloze")).select("*", source_info().alias("_info"), deck_tags().alias("_tags"))
    text = lambda c: math_content(F.coalesce(c, F.lit("")))
    about = [F.col("_info.source"), F.col("_info.page"), F.col("_info.section"), F.array_join("_tags", ";")]
    basic = F.array(text("front"), text("back"), *about, text("extra"))
    cloze = F.array(text("cloze_text"), text("extra"), *about)
    return rows.select(
        F.coalesce("id", F.lit("")).alias("guid"), deck_of(name, structure).alias("deck"), F.col("note_type").alias("model"),
        F.when(F.col("note_type") == "Basic", basic).otherwise(cloze).alias("fields"), F.col("_tags").alias("tags"),
    )


def previews(cards: DataFrame, n: int = 10, note_type: str | None = None) -> DataFrame:
    """The first cards by card_ord as they are shown: both sides cut at 80 characters, three tags, page range, short id. Pages
    may be numbers or the texts of a saved table."""
    c = cards if note_type is None else cards.where(F.col("note_type") == note_type)
    cloze = F.col("note_type") == "Cloze"
    cut = lambda x: F.when(F.length(x) > 80, F.concat(F.left(x, F.lit(80)), F.lit("..."))).otherwise(x)
    more = F.size("tags") - 3
    tags = F.concat(F.array_join(F.slice("tags", 1, 3), ", "), F.when(more > 0, F.format_string(" (+%d)", more)).otherwise(""))
    pages = F.when(F.col("page_start").isNotNull(), F.concat(F.col("page_start").cast("string"), F.lit("-"), F.coalesce(F.col("page_end").cast("string"), F.lit("?")))).otherwise("")
    return c.orderBy("card_ord").limit(n).select("card_ord", F.left("id", F.lit(12)).alias("short_id"), "note_type", cut(F.when(cloze, F.col("cloze_text")).otherwise(F.col("front"))).alias("side_a"), cut(F.when(cloze, F.col("extra")).otherwise(F.col("back"))).alias("side_b"), tags.alias("tags"), pages.alias("pages"))
