"""Checks of card tables and their statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import strip
from leafmill.operators.cards import cloze_count
from leafmill.plans.store import numbered

REQUIRED = ("id", "deck", "note_type", "tags", "media")
#: The columns whose completeness is reported.
METADATA = (
    "source_pdf", "page_start", "page_end", "section", "ref_citation", "llm_model", "llm_version", "strategy", "template_version", "created_at", "updated_at",
    "core_concept", "original_text",
)


def _blank(c: str) -> Column:
    return F.coalesce(strip(F.col(c).cast("string")) == "", F.lit(True))


def issues(cards: DataFrame, media_files: DataFrame | None = None) -> DataFrame:
    """severity, rule, field, note_type, n: one row for each kind of problem found; none for a sound table.

    All counts come from one pass over the table (duplicates and media have their own). ``media_files``: name. A field that
    a note type of the table needs and the table lacks is an error (n: the rows of that type). Content of one to four
    characters is short, blanks included; empty texts are as good as null ones.
    """
    have = set(cards.columns)
    rows: list[tuple[str, str, str, str]] = []
    counts: list[Column] = []

    def rule(severity: str, name: str, field: str, kind: str, hit: Column) -> None:
        rows.append((severity, name, field, kind))
        counts.append(F.count_if(F.coalesce(hit, F.lit(False))))

    for c in REQUIRED:
        if c not in have:
            rule("error", "missing_column", c, "", F.lit(True))
    empty = [c for c in REQUIRED if c in have]
    if "id" in have:
        rule("error", "empty_id", "id", "", _blank("id"))
        rule("warning", "id_length", "id", "", (F.col("id") != "") & ~F.length(strip(F.col("id").cast("string"))).between(4, 100))
    for c in ("page_start", "page_end"):
        if c in have:
            rule("warning", "page_not_numeric", c, "", ~_blank(c) & F.col(c).cast("string").try_cast("double").isNull())
    if "note_type" in have:
        kind = F.col("note_type")
        rule("error", "missing_note_type", "note_type", "", kind.isNull())
        rule("warning", "unknown_note_type", "note_type", "", ~kind.isin("Basic", "Cloze"))
        for t, fields in (("Basic", ("front", "back")), ("Cloze", ("cloze_text",))):
            for f in fields:
                if f in have:
                    rule("error", "empty_field", f, t, (kind == t) & _blank(f))
                else:
                    rule("error", "missing_field", f, t, kind == t)
        if "cloze_text" in have:
            rule("error", "no_cloze", "cloze_text", "Cloze", (kind == "Cloze") & ~_blank("cloze_text") & (cloze_count(F.col("cloze_text")) == 0))
            rule("warning", "many_cloze", "cloze_text", "Cloze", (kind == "Cloze") & (cloze_count(F.col("cloze_text")) > 5))
    for f in ("front", "back", "cloze_text", "extra"):
        if f in have:
            rule("warning", "long_content", f, "", F.length(f) > 10_000)
    for f in ("front", "back", "cloze_text"):
        if f in have:
            rule("warning", "short_content", f, "", F.length(f).between(1, 4))
    for c in empty:
        rows.append(("warning", "empty_column", c, ""))
        counts.append(((F.count(F.lit(1)) > 0) & (F.count(c) == 0)).cast("bigint"))
    one = cards.agg(*[x.alias(f"c{i}") for i, x in enumerate(counts)])
    names = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("severity", "rule", "field", "note_type"), r)], F.col(f"c{i}").alias("n")) for i, r in enumerate(rows)])
    parts = [one.select(F.inline(names))]
    if "id" in have:
        parts.append(duplicate_ids(cards).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("n")).select(F.lit("error").alias("severity"), F.lit("duplicate_id").alias("rule"), F.lit("id").alias("field"), F.lit("").alias("note_type"), "n"))
    if media_files is not None and "media" in have:
        parts.append(missing_media(cards, media_files).agg(F.count(F.lit(1)).alias("n")).select(F.lit("warning").alias("severity"), F.lit("missing_media").alias("rule"), F.lit("media").alias("field"), F.lit("").alias("note_type"), "n"))
    return reduce(DataFrame.unionByName, parts).where("n > 0")


def report(cards: DataFrame, media_files: DataFrame | None = None) -> DataFrame:
    """One row: valid (no error of any kind), n_errors and n_warnings (kinds of problems), total_rows, note_types, media_files."""
    found = issues(cards, media_files).agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    kinds = F.sort_array(F.collect_set("note_type")) if "note_type" in cards.columns else F.array().cast("array<string>")
    whole = cards.agg(F.count(F.lit(1)).alias("total_rows"), kinds.alias("note_types"))
    media = (media_names(cards) if "media" in cards.columns else cards.limit(0)).agg(F.count(F.lit(1)).alias("media_files"))
    # three rows of one
    return found.crossJoin(whole).crossJoin(media).select((F.col("n_errors") == 0).alias("valid"), "n_errors", "n_warnings", "total_rows", "note_types", "media_files")


def row_warnings(cards: DataFrame) -> DataFrame:
    """row (from 0, in card order), rule, detail of ids of odd length and of cards with over five cloze marks.

    Rows are numbered by ranges of card_ord: each range alone, after the rows of those before it."""
    n = cloze_count(F.col("cloze_text"))
    id_ = strip(F.col("id").cast("string"))
    found = F.filter(F.array(
        F.when((F.col("id") != "") & (F.length(id_) < 4), F.struct(F.lit("short_id").alias("rule"), id_.alias("detail"))),
        F.when(F.length(id_) > 100, F.struct(F.lit("long_id").alias("rule"), F.left(id_, F.lit(20)).alias("detail"))),
        F.when((F.col("note_type") == "Cloze") & (n > 5), F.struct(F.lit("many_cloze").alias("rule"), n.cast("string").alias("detail"))),
    ), lambda x: x.isNotNull())
    return numbered(cards, "card_ord", "row").select((F.col("row") - 1).alias("row"), F.inline(found))


#: The longest fields of the note types' rules.
LONGEST = {"Basic": {"front": 500, "back": 1000, "extra": 500}, "Cloze": {"cloze_text": 800, "extra": 500}}
NEEDED = {"Basic": ("front", "back"), "Cloze": ("cloze_text",)}


def broken_rules(cards: DataFrame) -> DataFrame:
    """note_type, field, rule (empty, too_long, no_cloze), n: what breaks the note types' own rules. One pass."""
    kind = F.col("note_type")
    tests = [(t, f, "empty", (kind == t) & _blank(f)) for t, fs in NEEDED.items() for f in fs]
    tests += [(t, f, "too_long", (kind == t) & (F.length(f) > n)) for t, fs in LONGEST.items() for f, n in fs.items()]
    tests.append(("Cloze", "cloze_text", "no_cloze", (kind == "Cloze") & ~_blank("cloze_text") & (cloze_count(F.col("cloze_text")) == 0)))
    one = cards.agg(*[F.count_if(F.coalesce(x, F.lit(False))).alias(f"c{i}") for i, (*_, x) in enumerate(tests)])
    rows = [F.struct(F.lit(t).alias("note_type"), F.lit(f).alias("field"), F.lit(r).alias("rule"), F.col(f"c{i}").alias("n")) for i, (t, f, r, _) in enumerate(tests)]
    return one.select(F.inline(F.array(*rows))).where("n > 0")


def duplicate_ids(cards: DataFrame) -> DataFrame:
    """id, extra: how many rows an id has beyond the first; nulls are one id."""
    return cards.groupBy("id").agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0")


def media_names(cards: DataFrame) -> DataFrame:
    """Distinct names; ``media`` is a list or a text with semicolons."""
    each = F.col("media") if dict(cards.dtypes)["media"].startswith("array") else F.split(F.coalesce("media", F.lit("")), ";")
    return cards.select(F.explode(each).alias("name")).select(strip(F.col("name")).alias("name")).where("name <> ''").distinct()


def missing_media(cards: DataFrame, files: DataFrame) -> DataFrame:
    """name of media that cards refer to and the folder lacks."""
    return media_names(cards).join(files.select("name").distinct(), "name", "left_anti")


def statistics(cards: DataFrame) -> DataFrame:
    """field, value, n for note_type, strategy and difficulty; nulls aren't counted. One pass, one shuffle."""
    fields = [c for c in ("note_type", "strategy", "difficulty") if c in cards.columns]
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return cards.select(F.inline(each)).where("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def completeness(cards: DataFrame) -> DataFrame:
    """field, percent of rows in which it is neither null nor blank."""
    fields = [c for c in METADATA if c in cards.columns]
    got = cards.agg(*[(F.avg(F.when(_blank(c), 0.0).otherwise(1.0)) * 100).alias(c) for c in fields])
    return got.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("percent")) for c in fields])))


def deck_name_ok(name: Column) -> Column:
    return F.coalesce((strip(name) != "") & (strip(name) == name) & ~name.rlike(r'[<>:"|?*/\\]'), F.lit(False))


def note_type_ok(config: dict) -> bool:
    """A note type needs fields and templates, neither empty."""
    return all(isinstance(config.get(k), list) and config[k] for k in ("fields", "templates"))
