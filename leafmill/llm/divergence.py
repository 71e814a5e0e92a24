"""How far each source's wording lies from the other sources of its language: a plain relational audit.

Terms are runs of bytes that belong to them, counted for each (lang, source, term). A language keeps the terms
that at least ``LEAST_DOCS`` of its documents hold. Its groups are crossed with its kept terms, so that terms a group
never uses count as zero; a self-join on (lang, term) then compares every two groups, and sums and ranks are windows
and aggregates over that. Shares are integers, in thousand-millionths with 1 added, so everything is exact.

Scale: texts are read once and never shuffled; the first aggregate sends one row for each (lang, source, term) of a
task, so frequent words and hot sources are summed before they move. The table of counts is stored, since four later
plans read it. Crossing makes groups x kept terms of a language; where the groups are few they are broadcast, else both
sides are dealt by (lang, salt). The self-join is keyed by (lang, term) and meets each two groups once, as the measure
is symmetric. Its rows grow with the square of the number of sources of one language, never with rows or documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import broadcast_if_small, stage, unstage
from leafmill.llm.words import LOWER, byte_set, runs, text_bytes
from leafmill.plans.ship import ship

LEAST_DOCS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
#: Over how many hash parts a language's terms are dealt where its groups can't be broadcast.
SALTS = 64
#: Bytes of terms; those of characters beyond ASCII are all among them.
TERM_BYTES = byte_set(range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100))
#: Bytes of rows that are cut and counted at a time.
SLICE_BYTES = 8 << 20
#: Below this, shares fit whole numbers of 64 bits.
PLAIN = 9_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold the term). A group without terms has one row with a null
    term, so every occurring group is there. Terms are cut on the bytes of a batch and counted in it before they move."""
    def read(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")).alias(c)

    ship(docs.sparkSession)
    each = docs.select(read("lang"), read("source"), read("text")).mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of each slice of a batch, and a row without a term for each group in it."""
    for batch in (b.slice(k, step) for b in batches for step in [max(1, int(b.num_rows * SLICE_BYTES / max(b.nbytes, 1)))] for k in range(0, b.num_rows, step)):
        names = [batch.column(c).dictionary_encode() for c in ("lang", "source")]
        lang, source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in names)
        group, member = np.unique(lang * len(names[1].dictionary) + source, return_inverse=True)
        raw, at = text_bytes(batch.column("text"))
        words, count = runs(LOWER[raw], at, TERM_BYTES)
        coded = words.dictionary_encode()
        terms = max(1, len(coded.dictionary))
        # a row for each term of a document, then for each term of a group
        held, times = np.unique(np.repeat(np.arange(len(count)), count) * terms + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        keys, place = np.unique(member[held // terms] * terms + held % terms, return_inverse=True)
        n, rows = np.bincount(place, times, len(keys)).astype(np.int64), np.bincount(place, minlength=len(keys))
        of, none = np.concatenate([keys // terms, np.arange(len(group))]), np.zeros(len(group), np.int64)
        term = pa.concat_arrays([coded.dictionary.take(pa.array(keys % terms)).cast(pa.string()), pa.nulls(len(group), pa.string())])
        columns = [x.dictionary.take(pa.array(k[of])) for x, k in zip(names, (group // len(names[1].dictionary), group % len(names[1].dictionary)))]
        yield pa.RecordBatch.from_arrays([*columns, term, pa.array(np.concatenate([n, none])), pa.array(np.concatenate([rows, none]))], names=["lang", "source", "term", "n", "docs"])


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * kept)), exact; in decimals where 64 bits don't hold it."""
    def wide(c: Column) -> Column:
        return c.cast("decimal(20,0)")

    plain = F.call_function("div", (n + 2) * F.lit(UNIT).cast("bigint"), total + 2 * kept)
    exact = F.call_function("div", wide(n + 2) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + 2 * kept))
    return (1 + F.when(n < PLAIN, plain).otherwise(exact)).cast("bigint")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)), in whole numbers."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def crossed(groups: DataFrame, terms: DataFrame, few: bool) -> DataFrame:
    """Every group of a language with each of its kept terms; a hot language is split by salt where groups aren't few."""
    if few:
        return terms.join(F.broadcast(groups), "lang")
    salted = terms.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["lang", "_salt"]).drop("_salt")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank.

    Null text, lang and source are read as the empty text, so they form groups of their own. Repeated rows count each;
    doc_id is not read. A group without terms takes part with zeros; a language without kept terms gives pairs of value
    0 and no terms, one with a single source no pairs. Ties rank by the item's UTF-8 bytes. Texts of any length are
    read whole. Other columns are ignored. An empty table gives none.
    """
    counts = stage(term_counts(docs), "terms")
    groups = counts.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    n_groups = groups.count()
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = stage(kept.where(F.col("docs") >= least_docs).select("lang", "term", "lang_n"), "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("V"), F.sum("lang_n").alias("lang_total"))  # a row for each language
    used = counts.join(kept.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    few = n_groups <= 100_000  # a row of two names and three numbers each
    about = groups.join(broadcast_if_small(totals, n_groups), ["lang", "source"], "left").join(broadcast_if_small(langs, n_groups), "lang")
    about = stage(about.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "V", "lang_total"), "groups")

    dense = crossed(about, kept, few).join(used, ["lang", "source", "term"], "left")
    n = F.coalesce("n", F.lit(0))
    dense = dense.select(
        "lang", "source", "term", n.alias("n"),
        share(n, F.col("total"), F.col("V")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("V")).alias("q"),
    )
    dense = stage(dense, "dense")

    # each two sources of a language once, the sum then told from both sides
    a = dense.select("lang", "term", "source", "p")
    b = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    sums = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(divergence(F.col("p"), F.col("q"))).alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    two = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item")  # rows of the result
    pairs = two.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    terms = dense.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    out = stage(out.select("lang", "source", "part", "item", F.col("value").cast("bigint").alias("value"), "rank"), "audit")
    for x in (counts, kept, about, dense):
        unstage(x)
    return out


AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
e AS (SELECT r, lang, source, unnest(t) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM e GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
c AS (SELECT e.lang, source, e.term, count(*)::HUGEINT AS n FROM e JOIN k ON e.lang = k.lang AND e.term = k.term GROUP BY e.lang, source, e.term),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(s.total, 0) + 2 * v.v) AS p, 1 + 1000000000 * (k.lang_n + 2) // (v.lang_total + 2 * v.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN s ON g.lang = s.lang AND g.source = s.source
  LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
p AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
t AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM m WHERE n > 0 AND p > q),
x AS (SELECT * FROM p UNION ALL SELECT * FROM t)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x) WHERE part = 'pair' OR rank <= 10
"""
