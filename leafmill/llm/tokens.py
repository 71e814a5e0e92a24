"""Exact byte-level BPE ids of whole texts through the tokenizers library, called once for each distinct piece.

A byte-level vocabulary is applied to each piece of its pre-tokenizer alone, so the pieces of a whole batch are cut here
on the text bytes, told apart, and only those that a worker has not met go to the library. The pre-tokenizer's rules:

* a run of white space is one piece at a text's end; elsewhere its last character is left over, which begins the next
  piece if it is a space and else is a piece of its own;
* a run of letters, of digits or of other signs is a piece, with one space before it if there is one.

Pieces of ASCII and of Latin letters up to U+024F are cut by a table of bytes. A word (what stands between white space)
with any other character or an apostrophe, whose classes and rules are finer, goes to the library whole. So does a text
in which white space beyond ASCII or a control separator stands beside other white space, or that holds the text of an
added token. Other kinds of tokenizers get all texts whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from leafmill.llm.common import held, single_thread, starts_of
from leafmill.llm.words import Store, binary_array, byte_set, distinct, spread, text_bytes

_LETTER, _DIGIT, _SIGN, _BLANK = range(4)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = _LETTER
_CLASS[list(b"0123456789")] = _DIGIT
_CLASS[list(b" \t\n\x0b\x0c\r")] = _BLANK
_CLASS[128:] = _LETTER
#: Apostrophes, and first bytes of characters other than U+00C0 to U+024F.
_HARD = byte_set(b"'\x1c\x1d\x1e\x1f", range(0xC0, 0xC3), range(0xCA, 256))
#: U+00D7 and U+00F7 are C3 97 and C3 B7: signs among the letters.
_SIGNS = (0x97, 0xB7)
#: White space beyond ASCII, and separators that some classes count as such; by first byte.
_WIDE = [chr(i).encode() for i in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_SPLIT = "\x1f"


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's printable character for each byte: itself where printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def pieces(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places in ``raw`` where the pre-tokenizer's pieces begin; words with hard characters stay whole."""
    if not len(raw):
        return np.zeros(0, np.int64)
    c = _CLASS[raw]
    blank = c == _BLANK
    first = np.unique(at[:-1][at[:-1] < len(raw)])
    cut = np.empty(len(raw), bool)
    cut[0] = True
    np.not_equal(c[1:], c[:-1], out=cut[1:])
    inner = cut[1:] & ~blank[1:] & ~blank[:-1]  # between two classes inside a word
    cut[1:] &= (raw[:-1] != 32) | blank[1:]  # a space goes with what follows
    if len(raw) > 2:
        # the last of several blanks stands apart, unless they end the text
        tail = blank[1:-1] & blank[:-2] & ~blank[2:]
        ends = first[first > 1] - 2
        tail[ends[ends < len(tail)]] = False
        cut[1:-1] |= tail
    cut[first] = True
    begin = np.flatnonzero(cut)
    hard = np.flatnonzero(_HARD[raw])
    signs = np.flatnonzero((raw == _SIGNS[0]) | (raw == _SIGNS[1]))
    signs = signs[signs > 0]
    hard = np.concatenate([hard, signs[raw[signs - 1] == 0xC3]])
    if len(hard):
        inside = np.zeros(len(raw), bool)
        inside[1:] = inner
        inside[first] = False
        inside = inside[begin]
        word = np.cumsum(~inside)
        bad = np.zeros(int(word[-1]) + 1, bool)
        bad[word[np.searchsorted(begin, hard, "right") - 1]] = True
        begin = begin[~inside | ~bad[word]]
    return begin


class BpeWords:
    def __init__(self, path: str):
        single_thread()
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.store = Store(self._fill, "<u4")
        self.byte_level = '"ByteLevel"' in self.t.to_str()[:2000] and self.t.normalizer is None
        self.alphabet = _byte_alphabet() | {ord(_SPLIT): _SPLIT}
        self.added = [x.content.encode() for x in self.t.get_added_tokens_decoder().values() if x.content]
        self.rare = byte_set([x[0] for x in (*_WIDE, *self.added)])
        self.simple = bytes(i for i in range(256) if not _HARD[i] and i not in _SIGNS)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.array([len(x) for x in ids], np.int64)
        return np.array([i for x in ids for i in x], np.uint32), n

    def _fill(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of one class go to the model; words with hard characters to the whole library path."""
        easy = [not w.translate(None, self.simple) for w in words]
        hard = [w.decode("utf-8", "replace") for w, e in zip(words, easy) if not e]
        soft = _SPLIT.encode().join([w for w, e in zip(words, easy) if e]).decode("latin1").translate(self.alphabet).split(_SPLIT)
        easy, n, tokens = np.array(easy, bool), np.zeros(len(words), np.int64), self.t.model.tokenize
        ids = [[x.id for x in tokens(w)] for w in soft] if easy.any() else []
        n[easy] = [len(x) for x in ids]
        flat = np.array([i for x in ids for i in x], np.uint32)
        if hard:
            more, m = self._plain(hard)
            n[~easy] = m
            # soft ids lie before hard ones; put the runs into the words' order
            start = np.empty(len(words), np.int64)
            start[easy], start[~easy] = starts_of(n[easy])[:-1], starts_of(m)[:-1] + len(flat)
            flat = np.concatenate([flat, more])[spread(start, n)]
        return flat, n

    def _whole(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which texts have to go to the library whole."""
        out = np.zeros(len(at) - 1, bool)
        if not self.byte_level:
            out[:] = True
            return out
        seen = np.flatnonzero(self.rare[raw])
        if not len(seen):
            return out
        after = np.concatenate([raw, np.zeros(max(map(len, (*_WIDE, *self.added))) + 1, np.uint8)])

        def found(x: bytes) -> np.ndarray:
            k = seen
            for i, v in enumerate(x):
                k = k[after[k + i] == v]
            return k

        wide = [(k, k + len(x)) for x in _WIDE if len(k := found(x))]
        hits = [found(x) for x in self.added]
        if wide:
            begin, end = (np.concatenate([w[i] for w in wide]) for i in (0, 1))
            blank = np.concatenate([_CLASS[raw] == _BLANK, [False]])
            blank[begin] = True  # beside another wide one
            tails = blank.copy()
            tails[end - 1] = True
            hits.append(begin[blank[end] | (tails[begin - 1] & (begin > 0))])
        out[np.searchsorted(at, np.concatenate(hits), "right") - 1] = True
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        raw, at = text_bytes(texts)
        whole = self._whole(raw, at)
        if whole.any():
            keep = np.flatnonzero(~whole)
            size = np.diff(at)[keep]
            some, n_some = self._cut(raw[spread(at[:-1][keep], size)], starts_of(size))
            odd = np.flatnonzero(whole)
            rest, n_rest = self._plain([raw[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace") for i in odd])
            n, start = np.empty(len(whole), np.int64), np.empty(len(whole), np.int64)
            n[keep], n[odd] = n_some, n_rest
            start[keep], start[odd] = starts_of(n_some)[:-1], starts_of(n_rest)[:-1] + len(some)
            return np.concatenate([some, rest])[spread(start, n)], n
        return self._cut(raw, at)

    def _cut(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        begin = pieces(raw, at)
        words, which = distinct(binary_array(raw, np.append(begin, len(raw))))
        flat, start, count = self.store.find(words)
        n = count[which]
        ids = flat[spread(start[which], n)]
        upto = starts_of(n)
        return ids, np.diff(upto[np.searchsorted(begin, at)])


def bpe(path: str) -> BpeWords:
    """The one of a worker process for a vocabulary file."""
    return held(f"bpe {path}", lambda: BpeWords(path))
