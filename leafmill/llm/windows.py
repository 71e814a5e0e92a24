"""Near-equal windows: Karmarkar-Karp differencing in many ways.

Pieces of documents are partial partitions: k windows, of which one holds the piece. The two partitions with the
largest imbalance (most loaded window over least loaded) are merged so that they oppose each other, the fullest window
of one with the emptiest of the other, until one is left. Its windows are near equal. There are as many windows as the
ids need at least; whenever one exceeds the capacity, their number rises and all is differenced anew.

How even it ends depends on what small pieces there are. Documents are cut into pieces of at most a window, the
remainder first; one document of ``SOW`` (by a hash) has its remainder cut into grains of 1, 2, 4 ... ``GRAIN`` ids, which
level the windows. Where lengths still don't fit each other (all of 700 ids, for one), so that more than ``PADDING`` of
the windows is empty, everything is cut to half the piece length and packed again, down to an eighth of a window.

Scale: pieces are dealt by a hash into groups of about ``GROUP`` and each group is differenced alone. A full piece is a
window by itself and takes no part. A group holds numbers only, about 100 bytes a piece; ids and texts are never shuffled.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import only, scan, stage, starts_of, text_or_empty, tokenizer_path, unstage
from leafmill.llm.tokens import bpe
from leafmill.llm.words import spread

#: Pieces that are differenced together.
GROUP = 12_000
#: One document of so many has its remainder cut into grains of powers of two up to GRAIN.
SOW, GRAIN = 8, 64
#: Share of the windows that may stay empty before pieces are cut shorter.
PADDING = 0.01
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two partial partitions made one. A partition is (sums, handles) of its windows with pieces, sums ascending; all
    others are empty. Where both can't stand apart in k windows, the least loaded ones of each are joined, the larger of
    one with the smaller of the other; ``parent`` then leads from one handle to the other."""
    both = len(a[0]) + len(b[0]) - k
    if both > 0:
        low_sums, low = a[0][:both][::-1] + b[0][:both], a[1][:both][::-1]
        parent[b[1][:both]] = low
        sums, handles = np.concatenate([low_sums, a[0][both:], b[0][both:]]), np.concatenate([low, a[1][both:], b[1][both:]])
    else:
        sums, handles = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(sums, kind="stable")
    return sums[order], handles[order]


def difference(lengths: np.ndarray, k: int) -> np.ndarray:
    """The window of each piece, by differencing in k ways; windows are named by one of their pieces. Of equal imbalances
    the partition made first goes first."""
    n = len(lengths)
    parent = np.arange(n)
    parts = {i: (lengths[i : i + 1], parent[i : i + 1].copy()) for i in range(n)}
    heap = [(-s, i) for i, s in enumerate(lengths.tolist())]
    heapq.heapify(heap)
    for made in range(n, 2 * n - 1):
        a, b = parts.pop(heapq.heappop(heap)[1]), parts.pop(heapq.heappop(heap)[1])
        parts[made] = sums, _ = merge(a, b, k, parent)
        heapq.heappush(heap, (-int(sums[-1] - (sums[0] if len(sums) == k else 0)), made))
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def near_equal(lengths: np.ndarray, most: int) -> np.ndarray:
    """The window (0, 1, ...) of each piece; no window holds more than ``most``. Lengths are 1 to ``most``."""
    out = np.empty(len(lengths), np.int64)
    full = lengths == most
    out[full] = np.arange(full.sum())
    rest = lengths[~full]
    if not len(rest):
        return out
    k, step = int(-(-rest.sum() // most)), 0
    while True:
        root, window = np.unique(difference(rest, k), return_inverse=True)
        over = np.maximum(np.bincount(window, weights=rest) - most, 0).sum()
        if not over:
            out[~full] = full.sum() + window
            return out
        # as many more windows as what stands over would fill, and each time at least twice as many as before
        step = max(2 * step, int(-(-over // most)))
        k += step


def cut(n: np.ndarray, sown: np.ndarray, most: int, grain: int = GRAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of n >= 1 ids: a first remainder, in grains if the document is
    sown, and then pieces of ``most``."""
    first = (n - 1) % most + 1
    sizes = 1 << np.arange(grain.bit_length())
    # grains are 1, 2, 4 ... grain, over and over, and what is left of the remainder
    ends = np.cumsum(np.tile(sizes, -(-most // int(sizes.sum()))))
    parts = np.where(sown, np.searchsorted(ends, first) + 1, 1)
    count = parts + (n - first) // most
    doc = np.repeat(np.arange(len(n)), count)
    at = spread(np.zeros(len(n), np.int64), count)
    inside = at < parts[doc]
    begin = np.concatenate([[0], ends])
    start = np.where(inside, begin[np.minimum(at, len(begin) - 1)], first[doc] + (at - parts[doc]) * most)
    end = np.where(inside, np.where(at == parts[doc] - 1, first[doc], ends[np.minimum(at, len(ends) - 1)]), start + most)
    return doc, start, end - start


def token_pieces(docs: DataFrame, tokenizer: str, most: int, end_id: int, sow: int = SOW) -> DataFrame:
    """One row for each piece of at most ``most`` ids; ``doc_tokens`` counts the document's ids with the end id."""

    def one(b: pa.RecordBatch) -> dict:
        ids, n = bpe(tokenizer).encode(b.column("text"))
        at = starts_of(n)
        raw = memoryview(np.insert(ids, at[1:], end_id).astype("<u4").tobytes())
        at = starts_of(n + 1) * 4
        sown = np.array([xxhash.xxh64_intdigest(raw[i:j]) % sow == 0 for i, j in zip(at.tolist(), at[1:].tolist())], bool)
        doc, start, length = cut(n + 1, sown, most)
        begin = at[doc] + start * 4
        crc = [zlib.crc32(raw[i:j]) for i, j in zip(begin.tolist(), (begin + length * 4).tolist())]
        return {"doc_id": b.column("doc_id").take(pa.array(doc)), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": (n + 1)[doc]}

    return scan(only(docs, "doc_id", text_or_empty().alias("text")), PIECES, one)


def difference_groups(pieces: DataFrame, most: int, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to stored pieces. Pieces lie in a window in the order of (doc_id, start)."""
    groups = max(1, round(pieces.count() / group))

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        window = near_equal(g["length"].to_numpy(np.int64), most)
        g = g.assign(sequence_id=(int(key[0]) << 32) + window).sort_values(["sequence_id", "doc_id", "start"], kind="stable")
        return g.assign(offset=g.groupby("sequence_id")["length"].cumsum() - g["length"]).drop(columns="_g")

    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("_g").applyInPandas(one, PACKED)


def near_equal_windows(
    docs: DataFrame, tokenizer: str | None = None, most: int = 1024, end_id: int = 0, group: int = GROUP, padding: float = PADDING,
) -> DataFrame:
    """Packs all documents; columns of ``PACKED``.

    Null and empty texts hold one id (the end id). Long texts are cut, never shortened. Repeated rows are packed once for
    each row; equal lengths are taken in the order of (doc_id, start). An empty table gives no rows. Columns other than
    doc_id and text are ignored. A null doc_id stays null.
    """
    longest = most
    while True:
        pieces = stage(token_pieces(docs, tokenizer or tokenizer_path(), longest, end_id), "pieces")
        out = stage(difference_groups(pieces, most, group), "packed")
        unstage(pieces)
        # a window of a power of two needs no padding
        got = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(
            F.sum("n").alias("ids"), F.sum(F.when(F.expr("n & (n - 1)") == 0, 0).otherwise(most - F.col("n"))).alias("empty"), F.countDistinct(F.shiftright("sequence_id", 32)).alias("groups"),
        ).first()
        spare = got["empty"] or 0
        # what the last window of each group leaves empty can't be helped
        if spare <= padding * (got["ids"] or 0) + most * got["groups"] or longest <= max(1, most // 8):
            return out
        unstage(out)
        longest //= 2
