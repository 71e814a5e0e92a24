"""Language identification: known words first, then ever shorter character n-grams.

A word that the sample knows scores, for each language, log(p + e): p is its smoothed share of that language's words, e a
small floor common to all languages. An unseen word falls back to its character n-grams of the longest length that the
sample knows any of (5, 4, 3, 2, 1), scored alike and averaged. Scores are counted from the floor, so a language that has
not seen a word adds 0. A text's language is the one of the highest mean score over its words; ``score`` is that
language's share of the languages' likelihoods over at most ``CERTAIN`` words' worth of evidence.

The model is fitted on a bounded sample: about ``SAMPLE`` labelled documents for each language, chosen by a hash of doc_id,
so alike on every run. Every labelled language and every word of the sample counts. Words and n-grams are counted on the
executors, as hashes; the driver gets one row for each (hash, language). Predictions are made for all documents, in one pass.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import broadcast_if_small, held, held_out, mix, odd, only, scan, scan_with, starts_of
from leafmill.llm.words import BLANK, Store, distinct, runs, spread, sums, text_bytes, word_hashes

#: The documented bound of the sample: documents of each language.
SAMPLE = 1_000
LONGEST = 5
CERTAIN = 12
#: Words added to each language's total, so that a tiny sample is not overconfident.
DAMP = 200.0
FLOOR = 0.1


def letters(word: str) -> str:
    """A word without what is not a letter at its ends; empty if it has no letter."""
    if word.isalpha():
        return word
    i, j = 0, len(word)
    while i < j and not word[i].isalpha():
        i += 1
    while j > i and not word[j - 1].isalpha():
        j -= 1
    return word[i:j]


def hashed(words: list[str]) -> np.ndarray:
    return word_hashes([w.encode("utf-8", "replace") for w in words])


class Grams:
    """The n-grams of words, each between two spaces, as hashes of their code points."""

    def __init__(self, words: list[str]):
        text = f" {'  '.join(words)} " if words else ""
        self.code = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        self.size = np.array([len(w) + 2 for w in words], np.int64)
        self.at = starts_of(self.size)[:-1]

    def of(self, n: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, how many each word has) for the chosen words."""
        count = np.maximum(self.size[which] - n + 1, 0)
        at = spread(self.at[which], count)
        h = np.full(len(at), n, np.uint64)
        for k, c in enumerate(odd(n, 31)):
            h += self.code[at + k] * c
        return mix(h), count


class LanguageModel:
    """Table 0 has words, table n n-grams: sorted hashes, for each the languages that have it and their scores."""

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.langs, self.tables = langs, tables
        self.store = Store(self.fill, "<f4")

    def look(self, table: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, scores by language) of hashes."""
        keys, start, lang, value = self.tables[table]
        out = np.zeros((len(h), len(self.langs)), np.float32)
        if not len(keys):
            return np.zeros(len(h), bool), out
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        known = keys[at] == h
        n = np.where(known, start[at + 1] - start[at], 0)
        k = spread(start[at], n)
        out[np.repeat(np.arange(len(h)), n), lang[k]] = value[k]
        return known, out

    def score(self, words: list[str]) -> np.ndarray:
        """Scores by language of each word (with letters)."""
        known, out = self.look(0, hashed(words))
        rest = np.flatnonzero(~known)
        grams = Grams([words[i] for i in rest])
        open_ = np.arange(len(rest))
        for n in range(LONGEST, 0, -1):
            # some words at a time: a word has many n-grams
            for part in np.array_split(open_, len(open_) // 20_000 + 1):
                h, count = grams.of(n, part)
                ok, v = self.look(n, h)
                some = np.repeat(np.arange(len(part)), count)[ok]
                n_ok = np.bincount(some, minlength=len(part))
                out[rest[part]] = sums(v[ok], n_ok) / np.maximum(n_ok, 1)[:, None]
                open_ = np.setdiff1d(open_, part[n_ok > 0], assume_unique=True)
        return out

    def fill(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each run between white space: the number of its words with letters, and their summed scores."""
        found = [[x for x in map(letters, w.decode("utf-8", "replace").lower().split()) if x] for w in raw]
        n = np.array([len(x) for x in found], np.int64)
        flat = [w for x in found for w in x]
        out = np.zeros((len(raw), len(self.langs) + 1), np.float32)
        out[:, 0] = n
        out[:, 1:] = sums(self.score(flat), n)
        return out.reshape(-1), np.full(len(raw), len(self.langs) + 1)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language or -1, score) of each text."""
        raw, at = text_bytes(texts)
        words, per = runs(raw, at, ~BLANK)
        words, which = distinct(words)
        rows = self.store.rows(words, len(self.langs) + 1)
        # one language after another, so that a batch never holds a row of all languages for each word
        n = sums(rows[which, 0].astype(np.float64), per)
        mean = np.stack([sums(rows[which, k + 1].astype(np.float64), per) for k in range(len(self.langs))], axis=1) / np.maximum(n, 1)[:, None]
        e = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.minimum(n, CERTAIN)[:, None])
        share = e.max(axis=1) / e.sum(axis=1)
        return np.where(n > 0, mean.argmax(axis=1), -1), np.where(n > 0, share, 0.0)


def sampled(docs: DataFrame, sample: int) -> tuple[list[str], DataFrame]:
    """The labelled languages, and about ``sample`` labelled documents of each as k (its number), text."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out())
    per = sorted(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())  # one row for each language
    share = docs.sparkSession.createDataFrame([(r["lang"], k, min(1.0, sample / r["n"])) for k, r in enumerate(per)], "lang string, k int, share double")
    # by a hash: without sorting or gathering a language in one place
    chosen = known.join(broadcast_if_small(share, len(per)), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    return [r["lang"] for r in per], chosen.select("k", "text")


def counted(chosen: DataFrame) -> DataFrame:
    """k, word, n of the sample."""

    def make():
        seen: dict[int, Counter] = {}

        def rows() -> dict:
            out = [(k, w, n) for k, c in seen.items() for w, n in c.items() if w]
            seen.clear()
            return {"k": [r[0] for r in out], "word": [r[1] for r in out], "n": [r[2] for r in out]}

        def one(b: pa.RecordBatch) -> dict | None:
            for k, text in zip(b.column("k").to_pylist(), b.column("text").to_pylist()):
                if text:
                    seen.setdefault(k, Counter()).update(map(letters, text.lower().split()))
            return rows() if sum(map(len, seen.values())) > 400_000 else None

        return one, rows

    return scan_with(only(chosen, "k", "text"), "k int, word string, n bigint", make).groupBy("k", "word").agg(F.sum("n").alias("n"))


def tables_of(words: DataFrame) -> DataFrame:
    """t, h, k, w: the weight in language k of hash h in table t (0: words, by number; n: n-grams, by the roots)."""

    def one(b: pa.RecordBatch) -> dict:
        k, n, w = b.column("k").to_numpy(), b.column("n").to_numpy(), b.column("word").to_pylist()
        grams, every = Grams(w), np.arange(len(w))
        out = [(np.zeros(len(w), np.int32), hashed(w), k, n.astype(np.float64))]
        for m in range(1, LONGEST + 1):
            h, count = grams.of(m, every)
            keys = np.rec.fromarrays([np.repeat(k, count), h], names="k,h")
            keys, back = np.unique(keys, return_inverse=True)
            out.append((np.full(len(keys), m, np.int32), keys["h"], keys["k"], np.bincount(back, np.repeat(np.sqrt(n), count), len(keys))))
        t, h, k, w = (np.concatenate(x) for x in zip(*out))
        return {"t": t, "h": h.view(np.int64), "k": k.astype(np.int32), "w": w}

    return scan(words, "t int, h bigint, k int, w double", one).groupBy("t", "h", "k").agg(F.sum("w").alias("w"))


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple | None:
    """The parts of a ``LanguageModel``; None without labelled rows."""
    langs, chosen = sampled(docs, sample)
    if not langs:
        return None
    got = tables_of(counted(chosen)).toArrow()  # bounded by the sample
    t, h, k, w = (got[c].to_numpy() for c in ("t", "h", "k", "w"))
    tables = []
    for n in range(LONGEST + 1):
        mine = np.flatnonzero(t == n)
        mine = mine[np.lexsort((k[mine], h[mine].view(np.uint64)))]
        keys, lang, c = h[mine].view(np.uint64), k[mine].astype(np.int16 if len(langs) < 1 << 15 else np.int32), w[mine]
        total = np.bincount(lang, c, len(langs)) + DAMP
        value = np.log1p(c / total[lang] * total.max() / FLOOR).astype(np.float32)
        keys, start = np.unique(keys, return_index=True)
        tables.append((keys, np.append(start, len(lang)).astype(np.int64), lang, value))
    return langs, tables


def _sent(docs: DataFrame, sample: int):
    """A function that gives a worker its model; None without labelled rows."""
    fitted = fit(docs.select("doc_id", "text", "lang"), sample)
    if fitted is None:
        return None
    sent = docs.sparkSession.sparkContext.broadcast(fitted)  # bounded by the sample: 14 bytes for each (hash, language)
    key = uuid.uuid4().hex
    return lambda: held(f"language {key}", lambda: LanguageModel(*sent.value))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row.

    Null texts and texts without a letter are ``und`` with score 0; without any labelled row all are. Equal means go to the
    first language by name. Repeated rows each get their row; an empty table gives none; a null doc_id isn't held out;
    other columns are ignored.
    """
    model = _sent(docs, sample)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def one(b: pa.RecordBatch) -> dict:
        m = model()
        k, score = m.predict(b.column("text"))
        return {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "lang_pred": pa.array([*m.langs, "und"]).take(pa.array(np.where(k < 0, len(m.langs), k))), "score": score}

    return scan(rows, "doc_id bigint, held_out boolean, lang_pred string, score double", one)


def recognised(docs: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` (all columns) whose language is known with at least this share; one pass, nothing is joined.

    Null texts and texts without a letter go. Without any labelled row nothing can be told, and all texts with a letter
    stay. Repeated rows are judged alike; an empty table gives none.
    """
    model = _sent(docs, sample)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        k, score = model().predict(b.column("text"))
        return b.filter(pa.array((k >= 0) & (score >= least)))

    return scan(docs, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes), one)
