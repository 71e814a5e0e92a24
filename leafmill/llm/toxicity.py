"""Toxicity by class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has a model of words, written character by character after the word's whole beginning:

    P_c(x | b) = (max(n_c(bx) - D, 0) + D k_c(b) P(x | b)) / n_c(b)

n_c counts word tokens of class c that begin with bx (an end mark closes a word), k_c the distinct x after b in class c,
D is the discount. P is shared by both classes: the share of distinct words (continuation counts, one added) beginning
with bx among those beginning with b. Where a class has not seen b, it is P itself. So a rare expression has the same
probability in both classes, and variants of a toxic stem still meet the stem.

Words are what stands between white space and signs that join words, without signs at their ends; a longer one than
``LONGEST`` characters counts as several, one after another, so every character of a text counts. A word's value is the
sum of log P_toxic - log P_ordinary over its characters, the difference of the two log-likelihoods. A text's features
are the difference normalised by its number of words and the sum of what its words have above ``NOISE``. A logistic curve over them gives the score; a text without words has the curve's value at 0, 0.

Counts cover all labelled rows of the folds for counting (crc32(doc_id) mod 4 of 0 or 1) and are summed on the
executors; they grow with the input. Fold 3 fits the curve, on about ``FIT_ROWS`` labelled rows chosen by a hash; fold
2 is never looked at. The table holds the beginnings that the toxic class has seen ``RARE`` times or more, and what
follows them. It is sent to the workers in blocks of at most ``BLOCK`` entries, split by the words' first two
characters; texts pass all blocks in one chain of scans, with nothing shuffled.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import BROADCAST_ROWS, fold_of, held, held_out, maybe_among, only, scan, scan_with, stage, starts_of, unstage
from leafmill.llm.langid import letters
from leafmill.llm.words import BLANK, Store, distinct, runs, sums, text_bytes

D = 0.75
RARE = 3
NOISE = 1.0
#: Longer words are cut into several of at most this many characters.
LONGEST = 24
FIT_ROWS = 20_000
BLOCK = 4_000_000
END = "\n"
PREDICT = 0.3


#: Signs between two words; others (stars, dollars, apostrophes) may stand for letters.
_JOINT = re.compile(r"[^\w*$@'\u2019]+|_+")


def expressions(run: bytes) -> list[str]:
    """The words of a run between white space."""
    out = []
    for x in run.decode("utf-8", "replace").lower().split():
        for w in [x] if x.isalpha() else _JOINT.split(x):
            if w := letters(w):
                out += [w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w), LONGEST)]
    return out


def word_counts(labelled: DataFrame) -> DataFrame:
    """word, t, o: tokens of each word in toxic and in ordinary texts. ``labelled``: text, toxic."""

    def make():
        seen = (Counter(), Counter())

        def rows() -> dict:
            words = list(set(seen[0]) | set(seen[1]))
            out = {"word": words, "t": [seen[1][w] for w in words], "o": [seen[0][w] for w in words]}
            for c in seen:
                c.clear()
            return out

        def one(b: pa.RecordBatch) -> dict | None:
            raw, at = text_bytes(b.column("text"))
            toxic = b.column("toxic").to_numpy(zero_copy_only=False) > 0
            words, per = runs(raw, at, ~BLANK)
            words, which = distinct(words)
            n = np.bincount(which * 2 + np.repeat(toxic, per), minlength=2 * len(words)).reshape(-1, 2).tolist()
            for run, counts in zip(words, n):
                for w in expressions(run):
                    for c, k in zip(seen, counts):
                        if k:
                            c[w] += k
            return rows() if len(seen[0]) + len(seen[1]) > 500_000 else None

        return one, rows

    counts = scan_with(only(labelled, "text", "toxic"), "word string, t bigint, o bigint", make)
    return counts.groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def steps(words: DataFrame, rare: int = RARE) -> DataFrame:
    """begin, value: what one more character adds to a word's difference, for beginnings under seen ones."""
    marked = F.concat("word", F.lit(END))
    begins = words.select("t", "o", F.explode(F.transform(F.sequence(F.lit(0), F.length(marked)), lambda i: F.substring(marked, F.lit(1), i))).alias("begin"))
    nodes = begins.groupBy("begin").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.count(F.lit(1)).alias("types"))
    nodes = stage(nodes, "nodes")
    known = nodes.where((F.col("t") >= rare) & ~F.endswith("begin", F.lit(END)))
    child = nodes.where(F.length("begin") > 0).withColumn("parent", F.expr("substring(begin, 1, length(begin) - 1)"))
    at = child.join(known.select(F.col("begin").alias("parent"), F.col("t").alias("pt"), F.col("o").alias("po"), F.col("types").alias("ptypes")), "parent")
    # a parent has as many children as there are characters, so its group is small
    w = Window.partitionBy("parent")
    at = at.select("begin", "t", "o", "types", "pt", "po", "ptypes", *[F.count_if(F.col(c) > 0).over(w).alias(f"k{c}") for c in "to"], F.count(F.lit(1)).over(w).alias("kids"))
    shared = (F.col("types") + 1) / (F.col("ptypes") + F.col("kids") + 1)

    def p(n: str, total: str, k: str) -> F.Column:
        return F.when(F.col(total) > 0, (F.greatest(F.col(n) - D, F.lit(0.0)) + D * F.col(k) * shared) / F.col(total)).otherwise(shared)

    value = F.log(p("t", "pt", "kt")) - F.log(p("o", "po", "ko"))
    # what a beginning has in store for a character never seen after it: both classes use the shared share
    unseen = F.log(D * F.col("kt") / F.col("pt")) - F.when(F.col("po") > 0, F.log(D * F.col("ko") / F.col("po"))).otherwise(0.0)
    seen = at.select("begin", value.alias("value"))
    other = at.where("kt > 0").groupBy(F.expr("substring(begin, 1, length(begin) - 1)").alias("b")).agg(F.first(unseen).alias("value")).select(F.concat("b", F.lit(END + END)).alias("begin"), "value")
    out = stage(seen.unionByName(other).where("value is not null"), "steps")
    unstage(nodes)
    return out


def begin_hashes(begins: list[str]) -> np.ndarray:
    """What Spark's xxhash64 gives for the texts."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "replace"), 42) for x in begins), np.uint64, len(begins))


class Values:
    """Words' values from one block of the table (sorted hashes of beginnings, values); a bounded number of words is kept."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, part: int, parts: int):
        self.keys, self.steps, self.part, self.parts = keys, values, part, parts
        self.store = Store(self.fill, "<f4")

    def look(self, begins: list[str]) -> np.ndarray:
        """The values of beginnings; nan where the block has none."""
        h = begin_hashes(begins)
        if not len(self.keys):
            return np.full(len(h), np.nan)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.steps[at], np.nan)

    def fill(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each run between white space: its words, their summed values and what they have above NOISE."""
        found = list(map(expressions, raw))
        n = np.array([len(x) for x in found], np.int64)
        v = self.values([w for x in found for w in x])
        return np.stack([n, sums(v, n), sums(np.maximum(v - NOISE, 0), n)], axis=1).reshape(-1), np.full(len(raw), 3)

    def values(self, words: list[str]) -> np.ndarray:
        """Each word's steps up to the first beginning that isn't known; there, each class's rest for the unseen, where
        that lowers the value."""
        mine = [i for i, w in enumerate(words) if part_of(w, self.parts) == self.part]
        out = np.zeros(len(words))
        if mine:
            marked = [words[i] + END for i in mine]
            at = starts_of([len(w) for w in marked])
            v = self.look([w[:k] for w in marked for k in range(1, len(w) + 1)])
            place = np.arange(len(v)) - np.repeat(at[:-1], np.diff(at))
            known = np.minimum.reduceat(np.where(np.isnan(v), place, len(v)), at[:-1])
            total = np.add.reduceat(np.where(place < np.repeat(known, np.diff(at)), np.nan_to_num(v), 0.0), at[:-1])
            stop = np.flatnonzero(known < np.diff(at))
            total[stop] += np.minimum(np.nan_to_num(self.look([marked[i][: known[i]] + END + END for i in stop])), 0.0)
            out[mine] = total
        return out


def part_of(word: str, parts: int) -> int:
    return (ord(word[0]) * 31 + (ord(word[1]) if len(word) > 1 else 7)) % parts if parts > 1 else 0


def features(docs: DataFrame, table: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` with n, total (the summed difference) and above (what exceeds NOISE, summed); no text."""
    spark = docs.sparkSession
    n = table.count()
    parts = max(1, math.ceil(n / block))
    first = F.ascii(F.substring("begin", 1, 1))
    second = F.when((F.length("begin") > 1) & (F.substring("begin", 2, 1) != END), F.ascii(F.substring("begin", 2, 1))).otherwise(7)
    # one character alone starts words of any part
    cols = [c for c in docs.columns if c != "text"]
    rows = docs.withColumns({"n": F.lit(0.0), "total": F.lit(0.0), "above": F.lit(0.0)})
    kinds = dict(rows.dtypes)
    for part in range(parts):
        mine = table if parts == 1 else table.where((F.length("begin") == 1) | (F.pmod(first * 31 + second, F.lit(parts)) == part) | F.endswith("begin", F.lit(END + END)) & (F.length("begin") <= 3))
        got = mine.select(F.xxhash64("begin").alias("h"), F.col("value").cast("float").alias("v")).toArrow()
        keys = got["h"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        sent = spark.sparkContext.broadcast((keys[order], got["v"].to_numpy()[order]))  # 12 bytes an entry, bounded by the block
        del got, keys, order
        last = part == parts - 1
        out = [*cols, *([] if last else ["text"]), "n", "total", "above"]
        rows = scan(rows, ", ".join(f"`{c}` {kinds[c]}" for c in out), _adder(sent, part, parts, out, uuid.uuid4().hex))
    return rows


def _adder(sent, part: int, parts: int, out: list[str], key: str):
    def one(b: pa.RecordBatch) -> dict:
        values = held(f"toxic {key}", lambda: Values(*sent.value, part, parts))
        raw, at = text_bytes(b.column("text"))
        words, per = runs(raw, at, ~BLANK)
        words, which = distinct(words)
        v = values.store.rows(words, 3)
        add = {c: sums(v[which, k].astype(np.float64), per) for k, c in enumerate(("n", "total", "above"))}
        add["n"] = add["n"] if part == 0 else np.zeros(b.num_rows)  # every part counts the words
        got = {c: b.column(c) for c in out if c not in add}
        return got | {c: b.column(c).to_numpy() + x for c, x in add.items()}

    return one


def shape(n: np.ndarray, total: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Columns of the curve: one, the normalised difference, its positive evidence for the text and for each word."""
    size = np.maximum(n, 1)
    return np.stack([np.ones(len(n)), np.clip(total / size, -2, 2), np.log1p(np.maximum(above, 0)), np.sqrt(np.maximum(above, 0) / size)], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, 1e-2, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` with their marks. Few marks are broadcast; with more, unlabelled texts are turned away before the shuffle."""
    n = marks.count()
    return rows.join(F.broadcast(marks), "doc_id") if n <= BROADCAST_ROWS else maybe_among(rows, marks, "doc_id").join(marks, "doc_id")


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, rare: int = RARE) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``.

    ``labels``: doc_id, toxic; null labels don't count; a doc_id labelled twice counts by its greatest label. Null and
    empty texts get the score of no evidence. Without labelled rows of both classes that is 0.5 for every text. Repeated
    rows each get their row; an empty table gives none; a null doc_id isn't held out; other columns are ignored.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    rows = docs.select("doc_id", "text")
    words = stage(word_counts(labelled(rows, marks.where(fold_of() < 2)).select("text", "toxic")), "words")
    table = steps(words, rare)
    unstage(words)
    wanted = marks.where(fold_of() == 3)
    n = max(1, wanted.count())
    wanted = wanted.where(F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(1 << 20)) < min(1.0, fit_rows / n) * (1 << 20))
    fit = features(labelled(rows, wanted).select("doc_id", "text", "toxic"), table).select("n", "total", "above", "toxic").toPandas()  # bounded by fit_rows
    y = (fit["toxic"].to_numpy() > 0).astype(float)
    w = fit_curve(shape(*[fit[c].to_numpy(np.float64) for c in ("n", "total", "above")]), y) if 0 < y.sum() < len(y) else np.zeros(4)
    size, above = F.greatest("n", F.lit(1.0)), F.greatest("above", F.lit(0.0))
    z = w[0] + w[1] * F.greatest(F.least(F.col("total") / size, F.lit(2.0)), F.lit(-2.0)) + w[2] * F.log1p(above) + w[3] * F.sqrt(above / size)
    scored = features(rows, table)
    unstage(table)  # the workers have it
    out = scored.select("doc_id", held_out().alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PREDICT).cast("int"))
