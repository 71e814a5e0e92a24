"""Benchmark decontamination by spaced seeds.

Words (runs of letters, digits and underscores, lower-cased) are hashed. Each mask looks at ``len(mask)`` words in a
row and ignores the places marked 0. Equal seeds of a benchmark item and a document put both on one diagonal; there the
item's words are compared with the document's, word by word (places beyond the document's edges differ), and the passage
counts when, in some stretch of ``STRETCH`` words (the whole item if it is shorter), at least ``SHARE`` of the words
agree. Items under ``LEAST`` words must agree wholly; they are looked for by a mask of their own length.

No passage that would count is missed: for each length of 8 to 20 words, every pattern of differing words that the rule
accepts was enumerated (``least_hits`` does it again for the lengths at hand), and the two masks together fit between
differing words at 2 to 9 places at least, 7 of them for 20 words. Diagonals with fewer common seeds aren't compared.

Scale: items are hashed and those of equal words brought together (under their smallest id) on the executors. The driver
takes them in blocks of a bounded number of words (usually one); each block is sent to the workers and all documents pass
it once. Texts are never shuffled. A bitmap of a size that fits the block turns away nearly all places of a document.
"""

from __future__ import annotations

import itertools
import math
import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import broadcast_if_small, held, mix, odd, only, scan, stage, starts_of, unstage
from leafmill.llm.words import LOWER, WORDLIKE, binary_array, distinct, runs, spread, sums, text_bytes, word_hashes

MASKS = ("1101", "100011")
LEAST = 8
STRETCH = 20
SHARE = 0.75
#: Words of the benchmark that one block may hold.
BLOCK_WORDS = 2_000_000
#: Diagonals, or words compared, that are held at a time.
SLICE = 1 << 20
_WORD = re.compile(r"\w+")


def word_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words one after another, and how many each text has."""
    raw, at = text_bytes(texts)
    found, per = runs(LOWER[raw], at, WORDLIKE)
    found, which = distinct(found)
    # a run of ASCII is a word as it stands; others may hold signs beyond ASCII
    words = [[w] if w.isascii() else [x.encode() for x in _WORD.findall(w.decode("utf-8", "replace").lower())] for w in found]
    n = np.array([len(x) for x in words], np.int64)
    h = word_hashes([x for ws in words for x in ws])
    count = n[which]
    return h[spread(starts_of(n)[:-1][which], count)], sums(count, per)


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The seed at each place of ``h`` from which the mask fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    by = odd(len(mask), int(mask, 2))
    out = np.zeros(n, np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out += h[k : k + n] * by[k]
    return mix(out)


@lru_cache(maxsize=256)
def least_hits(n: int, off: int) -> int:
    """The common seeds that n words have at least, of which ``off`` differ, by looking at every pattern."""
    if math.comb(n, off) > 500_000:
        raise ValueError(f"too many patterns of {off} of {n} words to prove the masks")
    places = np.array(list(itertools.combinations(range(n), off)), np.int64).reshape(-1, off)
    same = np.ones((len(places), n), bool)
    same[np.arange(len(places))[:, None], places] = False
    hits = np.zeros(len(places), np.int64)
    for mask in MASKS:
        for p in range(n - len(mask) + 1):
            hits += same[:, [p + k for k, c in enumerate(mask) if c == "1"]].all(axis=1)
    if not hits.min():
        raise ValueError(f"the masks can miss {off} of {n} words that differ")
    return int(hits.min())


def masks_for(n: int, least: int, stretch: int, share: float) -> tuple[list[str], int]:
    """(masks for items of n words, seeds of theirs that a passage has on its diagonal at least)."""
    if n < least:
        return ["1" * n], 1
    need = min(n, stretch)
    return list(MASKS), least_hits(need, need - math.ceil(share * need))


class Block:
    """A block of benchmark items: their words one after another, and all seeds sorted."""

    def __init__(self, ids: list[int], items: list[np.ndarray], stretch: int = STRETCH, share: float = SHARE, least: int = LEAST):
        self.ids = np.array(ids, np.int64)
        self.words, self.at = np.concatenate([*items, np.zeros(0, np.uint64)]), starts_of([len(x) for x in items])
        keys, item, place, used = [], [], [], {}
        self.least_seeds = np.ones(len(items), np.int64)
        for i, x in enumerate(items):
            which, self.least_seeds[i] = masks_for(len(x), least, stretch, share)
            for m in which:
                used[m] = None
                s = seeds(x, m)
                keys.append(s)
                item.append(np.full(len(s), i, np.int64))
                place.append(np.arange(len(s), dtype=np.int64))
        self.used = list(used)
        keys, item, place = (np.concatenate([*x, np.zeros(0, x[0].dtype if x else np.int64)]) for x in (keys, item, place))
        order = np.argsort(keys, kind="stable")
        keys, item, place = keys[order].astype(np.uint64), item[order], place[order]
        # places in a row with one seed, as repeated words have them, are one entry with a length
        first = run_starts(keys, item, place)
        self.keys, self.item, self.place = keys[first], item[first], place[first]
        self.length = np.diff(np.append(first, len(keys)))
        # 16 marks for each key
        width = max(16, (16 * len(keys)).bit_length())
        self.low = np.uint64(64 - width)
        self.bits = np.zeros(1 << width, bool)
        self.bits[self.keys >> self.low] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        """(item, diagonal) of the common seeds where they are enough, each pair once; a diagonal is document place less item place.

        A run of L equal seeds of the documents and one of M of an item share the L + M - 1 diagonals between them, with
        up to min(L, M) seeds each: so repeated words cost what they are long, not their product. Runs are taken a bounded
        number of diagonals at a time, and only distinct ones are kept.
        """
        found, shift = [np.zeros((2, 0), np.int64)], 1 << 32
        for m in self.used:
            s = seeds(h, m)
            at = np.flatnonzero(self.bits[s >> self.low])
            if not len(at):
                continue
            first = run_starts(s[at], at)
            at, size = at[first], np.diff(np.append(first, len(at)))
            lo, hi = np.searchsorted(self.keys, s[at], "left"), np.searchsorted(self.keys, s[at], "right")
            at, size, lo, n = (x[hi > lo] for x in (at, size, lo, hi - lo))
            # pairs of a run and an entry, as many at a time as have SLICE diagonals
            pairs, done, step = starts_of(n), 0, SLICE
            while done < pairs[-1]:
                p = np.arange(done, min(done + step, int(pairs[-1])))
                run = np.searchsorted(pairs, p, "right") - 1
                entry = lo[run] + p - pairs[run]
                upto = max(1, int(np.searchsorted(np.cumsum(size[run] + self.length[entry] - 1), SLICE, "right")))
                found.append(self._diagonals(at[run[:upto]], size[run[:upto]], entry[:upto], shift))
                if sum(x.shape[1] for x in found) > SLICE:
                    found = [counted(found)]
                done, step = done + min(upto, len(p)), max(16, min(SLICE, 4 * upto))
        both, n = counted(found)
        both = both[n >= self.least_seeds[both // shift]]
        return np.stack([both // shift, both % shift - shift // 2], axis=1)

    def _diagonals(self, at: np.ndarray, size: np.ndarray, entry: np.ndarray, shift: int) -> np.ndarray:
        """Diagonals (with their items) and their common seeds of runs of the documents, each with an entry."""
        length = self.length[entry]
        wide = size + length - 1
        step = spread(np.zeros(len(wide), np.int64), wide)
        weight = np.minimum(np.minimum(step + 1, np.repeat(wide, wide) - step), np.repeat(np.minimum(size, length), wide))
        first = self.item[entry] * shift + at - self.place[entry] - length + 1 + shift // 2
        return counted([np.stack([np.repeat(first, wide) + step, weight])])

    def overlaps(self, h: np.ndarray, at: np.ndarray, found: np.ndarray, stretch: int, share: float, least: int) -> dict[tuple[int, int], tuple[int, int]]:
        """(document, item) -> (words that agree, words compared) in the best stretch, if enough agree. ``at``: where the documents
        begin in h. All diagonals of an item are compared as one matrix, a bounded part at a time."""
        out: dict[tuple[int, int], tuple[int, int]] = {}
        order = np.argsort(found[:, 0], kind="stable")
        items, first = np.unique(found[order, 0], return_index=True)
        for i, diagonals in zip(items.tolist(), np.split(found[order, 1], first[1:])):
            x = self.words[self.at[i] : self.at[i + 1]]
            need = min(len(x), stretch)
            enough = (share if len(x) >= least else 1) * need
            # the documents that the item's words would span on each diagonal
            begin = np.searchsorted(at, np.maximum(diagonals, 0), "right") - 1
            end = np.searchsorted(at, np.minimum(diagonals + len(x), at[-1]), "left")
            doc, d = spread(begin, np.maximum(end - begin, 0)), np.repeat(diagonals, np.maximum(end - begin, 0))
            best = np.zeros(len(at), np.int64)
            step = max(1, SLICE // len(x))
            for k in range(0, len(d), step):
                place = d[k : k + step, None] + np.arange(len(x))
                own = doc[k : k + step, None]
                same = (place >= at[own]) & (place < at[own + 1])
                same &= h[np.clip(place, 0, len(h) - 1)] == x
                sums_ = np.zeros((len(same), len(x) + 1), np.int32)
                np.cumsum(same, axis=1, out=sums_[:, 1:])
                np.maximum.at(best, doc[k : k + step], (sums_[:, need:] - sums_[:, :-need]).max(axis=1))
            for k in np.flatnonzero(best >= max(enough, 1)).tolist():
                out[k, i] = (int(best[k]), need)
        return out


def run_starts(keys: np.ndarray, *places: np.ndarray) -> np.ndarray:
    """Where runs begin of equal keys (and equal further columns but the last) whose last column counts up by one."""
    if not len(keys):
        return np.zeros(0, np.int64)
    new = (keys[1:] != keys[:-1]) | (np.diff(places[-1]) != 1)
    for c in places[:-1]:
        new |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def counted(found: list[np.ndarray]) -> np.ndarray:
    """Distinct keys and their summed weights of (keys, weights)."""
    keys, weight = np.concatenate(found, axis=1)
    order = np.argsort(keys, kind="stable")
    keys, weight = keys[order], weight[order]
    if not len(keys):
        return np.zeros((2, 0), np.int64)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return np.stack([keys[first], np.add.reduceat(weight, first)])


def distinct_items(benchmark: DataFrame) -> DataFrame:
    """item_id (the smallest of equal ones), words (hashes, binary); staged."""

    def one(b: pa.RecordBatch) -> dict:
        h, n = word_lists(b.column("text"))
        return {"item_id": b.column("item_id"), "words": binary_array(h.astype("<u8").view(np.uint8), starts_of(n * 8)).cast(pa.binary())}

    rows = scan(only(benchmark, "item_id", "text").where("text is not null and item_id is not null"), "item_id bigint, words binary", one)
    rows = rows.where(F.octet_length("words") > 0).groupBy("words").agg(F.min("item_id").alias("item_id"))
    return stage(rows.select("item_id", "words"), "items")


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS):
    """The benchmark's distinct items, block after block; ids ascend."""
    ids, items, n = [], [], 0
    stored = distinct_items(benchmark)
    for r in stored.orderBy("item_id").toLocalIterator():
        ids.append(r["item_id"])
        items.append(np.frombuffer(bytes(r["words"]), "<u8").astype(np.uint64))
        n += len(items[-1])
        if n >= most:
            yield ids, items
            ids, items, n = [], [], 0
    if ids:
        yield ids, items
    unstage(stored)


def overlaps(docs: DataFrame, benchmark: DataFrame, stretch: int = STRETCH, share: float = SHARE, least: int = LEAST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, n_same, n_compared: one row for each document row and benchmark item that it holds.

    Clean documents have no row; nor have null, empty and wordless texts, null ids and items without words. Items
    under ``least`` words are looked for exactly. Items of equal words count as the one of the smallest id, however many
    blocks there are. Repeated rows each get theirs. An empty table on either side gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, n_same int, n_compared int"
    rows = only(docs, "doc_id", "text").where("text is not null and doc_id is not null")
    out = spark.createDataFrame([], schema)
    waiting = None
    for ids, items in blocks(benchmark, block_words):
        if waiting is not None:  # of several blocks only one is with the workers at a time
            out = out.unionByName(stage(waiting[0], "overlaps"))
            waiting[1].destroy()
        sent = spark.sparkContext.broadcast((ids, items))  # bounded by block_words and one item
        waiting = scan(rows, schema, _finder(sent, stretch, share, least)), sent
    return out if waiting is None else out.unionByName(waiting[0])


def _finder(sent, stretch: int, share: float, least: int):
    key = uuid.uuid4().hex

    def one(b: pa.RecordBatch) -> dict | None:
        block = held(f"benchmark {key}", lambda: Block(*sent.value, stretch, share, least))
        h, counts = word_lists(b.column("text"))
        at = starts_of(counts)
        # all documents of the batch at once; seeds across two documents are turned away on the diagonal
        found = block.hits(h)
        if not len(found):
            return None
        best = block.overlaps(h, at, found, stretch, share, least)
        ids = b.column("doc_id").to_pylist()
        rows = [(ids[k], int(block.ids[i]), *x) for (k, i), x in sorted(best.items())]
        return {n: [r[j] for r in rows] for j, n in enumerate(("doc_id", "item_id", "n_same", "n_compared"))}

    return one


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage; null ids stay."""
    bad = stage(overlaps(docs, benchmark).select("doc_id").distinct(), "bad")
    return docs.join(broadcast_if_small(bad, bad.count()), "doc_id", "left_anti").select(docs.columns)
