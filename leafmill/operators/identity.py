"""Card identity: content keys, BLAKE2b ids, persistent numbered ids."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import collapse
from leafmill.plans.ship import ship
from leafmill.plans.store import numbered


def normal_content() -> Column:
    """The texts that make a card, by note type, in lower case with single spaces."""
    x = {c: F.coalesce(c, F.lit("")) for c in ("front", "back", "cloze_text", "extra")}
    joined = F.when(F.col("note_type") == "Basic", F.concat_ws("||", x["front"], x["back"])).when(F.col("note_type") == "Cloze", F.concat_ws("||", x["cloze_text"], x["extra"])).otherwise(F.concat_ws("||", *x.values()))
    return F.lower(collapse(joined))


def content_key(salt: str) -> Column:
    span = F.concat(F.coalesce(F.col("page_start").cast("string"), F.lit("")), F.lit("-"), F.coalesce(F.col("page_end").cast("string"), F.lit("")))
    return F.concat_ws("|", F.lit(salt), F.coalesce("note_type", F.lit("")), normal_content(), F.coalesce("source_pdf", F.lit("")), span)


def _blake(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: None if k is None else hashlib.blake2b(k.encode(), digest_size=16).hexdigest())


def content_ids(cards: DataFrame, salt: str) -> DataFrame:
    """Adds id: 32 hex digits of BLAKE2b over the content key (no SQL function has it, so an Arrow function does)."""
    ship(cards.sparkSession)
    return cards.withColumn("id", F.pandas_udf(_blake, "string")(content_key(salt)))


def persistence_key() -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_pdf", "page_start", "core_concept", "note_type", "strategy")])


def known_ids(cards: DataFrame) -> DataFrame:
    """key, id of earlier cards (with card_ord); the last row of a key wins."""
    return cards.where("id is not null and id <> ''").groupBy(persistence_key().alias("key")).agg(F.max_by("id", "card_ord").alias("id"))


def persistent_ids(cards: DataFrame, known: DataFrame, salt: str) -> DataFrame:
    """Adds id: the known one of the card's key, else ``salt_`` and the next number, in order of first appearance.

    Only new keys are numbered, by ranges of their first places; cards that share a key share an id.
    """
    last = known.select(F.max(F.regexp_extract("id", rf"^{salt}_([0-9]+)$", 1).try_cast("bigint")).alias("last"))
    c = cards.withColumn("_key", persistence_key())
    firsts = c.join(known.select(F.col("key").alias("_key")), "_key", "left_anti").groupBy("_key").agg(F.min("card_ord").alias("_at"))
    new = numbered(firsts, "_at", "_nth").crossJoin(F.broadcast(last)).select("_key", F.format_string(salt + "_%06d", F.coalesce("last", F.lit(0)).cast("bigint") + F.col("_nth")).alias("_new"))
    out = c.join(known.select(F.col("key").alias("_key"), F.col("id").alias("_old")), "_key", "left").join(new, "_key", "left")
    return out.withColumn("id", F.coalesce("_old", "_new")).drop("_key", "_old", "_new")
