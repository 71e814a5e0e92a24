"""Words of a whole Arrow batch at once: cut on the text bytes, told apart in Arrow, looked up once for each distinct word.

No Python object is made for an occurrence of a word, only for each distinct word of a batch. What a word stands for
(ids, hashes, scores) is filled in by a function over the distinct words that a worker has not met, and kept in a
``Store`` bounded in bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash

from leafmill.llm.common import starts_of

#: Bytes of keys and values that a worker's store may hold before it starts anew.
STORE_BYTES = 48 << 20


def byte_set(*groups: Iterable[int]) -> np.ndarray:
    """A table of 256 marks."""
    out = np.zeros(256, bool)
    for g in groups:
        out[list(g)] = True
    return out


#: ASCII white space of ``bytes.split``.
BLANK = byte_set(b" \t\n\x0b\x0c\r")
#: Bytes of words and of all characters beyond ASCII.
WORDLIKE = byte_set(b"0123456789_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", range(128, 256))
#: What ``bytes.lower`` makes of each byte.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column, text after text, and where each begins (with the end behind them); nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def binary_array(data: np.ndarray | bytes, at: np.ndarray) -> pa.Array:
    """Values that lie one after another in ``data``, cut at ``at``."""
    if at[-1] >= 1 << 31:
        return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def runs(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The runs of marked bytes in each text, and how many each text has."""
    n = len(at) - 1
    m = inside[raw]
    if not m.any():
        return pa.array([], pa.binary()), np.zeros(n, np.int64)
    begin, end = m.copy(), m.copy()
    begin[1:] &= ~m[:-1]
    end[:-1] &= ~m[1:]
    first = at[:-1][at[:-1] < len(raw)]
    begin[first] |= m[first]  # a run never goes on into the next text
    last = at[1:][at[1:] > 0] - 1
    end[last] |= m[last]
    s, e = np.flatnonzero(begin), np.flatnonzero(end)
    return binary_array(raw[m], starts_of(e + 1 - s)), np.diff(np.searchsorted(s, at))


def distinct(words: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, and the place of each word among them."""
    if not len(words):
        return [], np.zeros(0, np.int64)
    d = words.dictionary_encode()
    raw, at = text_bytes(d.dictionary)
    data, at = raw.tobytes(), at.tolist()
    return [data[i:j] for i, j in zip(at, at[1:])], d.indices.to_numpy(zero_copy_only=False)


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter(map(h, words), np.uint64, len(words))


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... (count of them) of each run, run after run."""
    at = starts_of(count)
    return np.repeat(start - at[:-1], count) + np.arange(at[-1])


class Store:
    """Word to a run of values, filled by ``fill(words) -> (values of all words one after another, how many each has)``.

    Keys are 128-bit hashes in sorted arrays, so a word takes about 24 bytes and its values. Beyond ``most`` bytes the
    store starts anew with the next batch.
    """

    def __init__(self, fill: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kind: str, most: int = STORE_BYTES):
        self.fill, self.kind, self.most = fill, kind, most
        self.clear()

    def clear(self) -> None:
        self.k1, self.k2 = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat = np.zeros(0, self.kind)

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, start, count): word i has values[start[i] : start[i] + count[i]]."""
        if 24 * len(self.k1) + self.flat.nbytes > self.most:
            self.clear()
        if not words:
            return self.flat, np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
        order = np.argsort(h[:, 0], kind="stable")
        h1, h2 = h[order, 0], h[order, 1]
        at = np.searchsorted(self.k1, h1)
        start, count = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        known = np.zeros(len(h1), bool)
        inside = np.flatnonzero(at < len(self.k1))
        hit = inside[(self.k1[at[inside]] == h1[inside]) & (self.k2[at[inside]] == h2[inside])]
        known[hit] = True
        start[hit], count[hit] = self.start[at[hit]], self.count[at[hit]]
        new = np.flatnonzero(~known)
        flat = self.flat
        if len(new):
            values, n = self.fill([words[i] for i in order[new].tolist()])
            flat = np.concatenate([flat, np.asarray(values, self.kind)])
            start[new], count[new] = starts_of(n)[:-1] + len(self.flat), n
            # of words with equal first halves of their keys only one is kept
            fresh = np.ones(len(new), bool)
            fresh[1:] = h1[new][1:] != h1[new][:-1]
            fresh &= (at[new] >= len(self.k1)) | (np.append(self.k1, np.uint64(0))[at[new]] != h1[new])
            add, to = new[fresh], at[new][fresh]
            self.k1, self.k2 = np.insert(self.k1, to, h1[add]), np.insert(self.k2, to, h2[add])
            self.start, self.count = np.insert(self.start, to, start[add]), np.insert(self.count, to, count[add])
            self.flat = flat
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return flat, start[back], count[back]

    def rows(self, words: list[bytes], width: int) -> np.ndarray:
        """The values of words that have ``width`` each."""
        flat, start, _ = self.find(words)
        return flat[start[:, None] + np.arange(width)]


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sums of consecutive runs of ``counts`` rows; 0 for empty runs."""
    out = np.zeros((len(counts), *values.shape[1:]), np.result_type(values.dtype, np.int64) if values.dtype.kind in "iub" else np.float64)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(values, starts_of(counts)[:-1][full], axis=0)
    return out
