"""From a saved card table to a deck package."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import cards as cd
from leafmill.operators import chunking, deck
from leafmill.plans.cards import Generator, responses
from leafmill.plans.config import Config
from leafmill.plans.store import settle
from leafmill.sources import files, sinks


def build_deck(spark: SparkSession, config: Config, csv_path: str | None = None, out_path: str | None = None) -> dict:
    """Reads the card table, writes notes, decks and note types, and says what was written. A table without usable rows is
    an error; rows of other note types are left out and counted."""
    out, anki = config.generate.output, config.generate.anki
    cards = files.cards_csv(spark, csv_path or out.csv_path)
    # counted while the notes are written, not by passes of their own
    read, made = Observation("cards"), Observation("notes")
    seen = cards.observe(read, F.count(F.lit(1)).alias("n"), F.collect_set("note_type").alias("note_types"), F.collect_set("strategy").alias("strategies"))
    notes = deck.notes(seen, anki.deck_name, anki.deck_structure).observe(made, F.count(F.lit(1)).alias("n"))
    decks = deck.decks(cards, anki.deck_name, anki.deck_structure)
    path = out_path or out.apkg_path
    sinks.save_package(notes, decks, path)
    spark.createDataFrame([(t["name"], t["model_id"], t["kind"], t["fields"], t["css"]) for t in deck.note_types()], "name string, model_id bigint, kind string, fields array<string>, css string").write.mode("overwrite").parquet(f"{path}/note_types")
    r, m = read.get, made.get
    return {"path": path, "total_cards": m["n"], "skipped": r["n"] - m["n"], "decks": [x["deck"] for x in spark.read.parquet(f"{path}/decks").orderBy("deck").collect()], "note_types": sorted(r["note_types"]), "strategies": sorted(r["strategies"])}


def samples(pages: DataFrame, strategies: list[str], budget: int = 2000, most: int = 2, ask: Generator | None = None) -> DataFrame:
    """A look before a run: up to ``most`` cards of each strategy from the first chunk of each document's first three pages,
    made as in a run (see ``responses``)."""
    first = chunking.by_pages(pages.where("page_num <= 3"), budget).where("chunk_index = 0")
    out = None
    for s in strategies:
        got = cd.parse_responses(settle(responses(first, s, ask=ask))).where(F.col("card_no") < most).withColumn("preview", F.left(F.coalesce(F.nullif("front", F.lit("")), "cloze_text"), F.lit(200)))
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no strategy is given")
    return out
