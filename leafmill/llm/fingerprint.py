"""Canonical exact fingerprints, in built-in SQL functions only.

Canonical text: Unicode composition (NFC), full case folding, NFC again, every run of white space to one space, none
at the ends. Fingerprint: 128 bits from two seeded xxhash64 values of the canonical text, as 32 hex digits. Inside
each bucket of equal fingerprints that holds more than one row the canonical bytes are compared (their least and
greatest must agree); where they differ, every text of that bucket gets its own SHA-256 behind the digits. So equal
fingerprints mean equal canonical bytes.

ICU's composer and case folder are called through Spark SQL's ``java_method`` inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import broadcast_if_small, only, stage, text_or_empty, unstage
from leafmill.llm.tokenbin import bucket_of, range_of


def canonical(text: Column) -> Column:
    nfc = lambda x: F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(False))
    folded = nfc(F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfc(text), F.lit(True)))
    return F.trim(F.regexp_replace(folded, r"(?U)[\s\x1c-\x1f]+", " "))


def digest(canon: Column) -> Column:
    part = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    return F.concat(part(F.xxhash64(canon)), part(F.xxhash64(F.lit(1), canon)))


def collided(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """Fingerprints under which different canonical texts meet. ``rows``: fingerprint, canon; ``hashes``: a stored table
    of the fingerprints alone; staged. Rows whose fingerprint is alone aren't shuffled at all when the list of the others is short."""
    twice = stage(hashes.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint"), "twice")
    again = rows.join(broadcast_if_small(twice, twice.count()), "fingerprint", "left_semi")
    # partial aggregation: each task sends one row a fingerprint, however many copies it holds
    ends = again.groupBy("fingerprint").agg(F.min("canon").alias("a"), F.max("canon").alias("b"))
    out = stage(ends.where("a <> b").select("fingerprint"), "clash")
    unstage(twice)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row.

    Null counts as empty; empty and blank texts share one fingerprint; repeated rows each get their row; an empty table
    gives none; a null doc_id stays null; other columns are ignored.
    """
    rows = only(docs, "doc_id", canonical(text_or_empty()).alias("canon"))
    rows = rows.select("doc_id", digest(F.col("canon")).alias("fingerprint"), "canon")
    plain = stage(rows.drop("canon"), "digests")
    clash = collided(rows.drop("doc_id"), plain.select("fingerprint"))
    if clash.isEmpty():
        return plain
    rows = rows.select("doc_id", "fingerprint", F.sha2(F.col("canon"), 256).alias("_sha"))
    return _told_apart(rows, clash, "fingerprint", "_sha").select("doc_id", "fingerprint")


def _told_apart(rows: DataFrame, clash: DataFrame, column: str, sha: str) -> DataFrame:
    mark = clash.select(F.col("fingerprint").alias("_f"), F.lit(True).alias("_clash"))
    rows = rows.join(mark, F.col(column) == F.col("_f"), "left")
    return rows.withColumn(column, F.when(F.col("_clash"), F.concat(column, sha)).otherwise(F.col(column))).drop("_f", "_clash")


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text and next_text: the text of the next row by (doc_id, text); after the last, the first.

    Rows are dealt by ranges of doc_id. The first row of each range also goes, as a ghost, to the end of the range
    before, so each range finds all its neighbours in itself and texts are shuffled once.
    """
    rows = only(docs, "doc_id", text_or_empty().alias("text"))
    bounds = range_of(docs.select("doc_id"), "doc_id", parts)
    bucket = bucket_of("doc_id", bounds).cast("int")
    firsts = [(r["b"], r["first"]) for r in rows.select("doc_id", bucket.alias("b")).groupBy("b").agg(F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).orderBy("b").collect()]  # one row for each range
    nulls = rows.where("doc_id is null").limit(1).count() > 0
    if nulls and firsts:
        firsts[0] = (firsts[0][0], None)
    if not firsts:
        return rows.withColumn("next_text", F.lit(None).cast("string"))
    before = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}
    # by range number, so a row finds its entry at once
    known = dict(firsts)
    heads = F.array(*[F.lit(known.get(b)).cast("bigint") for b in range(len(bounds) + 1)])
    to = F.array(*[F.lit(before.get(b, b)).cast("int") for b in range(len(bounds) + 1)])
    rows = rows.withColumn("_b", bucket)
    is_first = F.col("doc_id").eqNullSafe(F.get(heads, F.col("_b")))
    copies = F.array(
        F.struct(F.col("_b").alias("b"), F.lit(0).alias("ghost")),
        F.when(is_first, F.struct(F.get(to, F.col("_b")).alias("b"), F.lit(1).alias("ghost"))),
    )
    rows = rows.select("doc_id", "text", F.explode(F.filter(copies, lambda x: x.isNotNull())).alias("_c"))
    rows = rows.select("doc_id", "text", F.col("_c.b").alias("_b"), F.col("_c.ghost").alias("_ghost"))
    w = Window.partitionBy("_b").orderBy("_ghost", F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    return rows.withColumn("next_text", F.lead("text").over(w)).where("_ghost = 0").drop("_b", "_ghost")


def edited_and_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to each other and to the next text's.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next text. An
    exact digest knows only equal (1.0) and different (0.0). A table of one row is its own next.
    """
    spark = docs.sparkSession
    pairs = with_next(docs, parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    # string functions on ASCII text take their short way only as long as the string is not copied; one pass here
    rows = pairs.select("doc_id", "text", "next_text", n.cast("bigint").alias("n_chars"), F.concat(F.substring("text", F.lit(1), (n - half)), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)).alias("_edited"))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        canonical(F.col("text")).alias("_c0"), canonical(F.col("_edited")).alias("_c1"), canonical(F.coalesce("next_text", F.lit(""))).alias("_c2"),
    )
    rows = rows.select("*", digest(F.col("_c0")).alias("fingerprint"), digest(F.col("_c1")).alias("edited_fingerprint"), digest(F.col("_c2")).alias("_next"))
    plain = stage(rows.drop("_c0", "_c1", "_c2"), "digests")
    both = F.array(F.struct(F.col("fingerprint").alias("f"), F.col("_c0").alias("c")), F.struct(F.col("edited_fingerprint").alias("f"), F.col("_c1").alias("c")))
    texts = rows.select(F.explode(both).alias("x")).select(F.col("x.f").alias("fingerprint"), F.col("x.c").alias("canon"))
    hashes = plain.select(F.explode(F.array("fingerprint", "edited_fingerprint")).alias("fingerprint"))
    clash = collided(texts, hashes)
    if not clash.isEmpty():
        plain = rows
        for c, f in (("_c0", "fingerprint"), ("_c1", "edited_fingerprint"), ("_c2", "_next")):
            plain = _told_apart(plain, clash, f, F.sha2(F.col(c), 256))
    return plain.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double").alias("near_edited"),
        (F.col("fingerprint") == F.col("_next")).cast("double").alias("near_next"),
    )
