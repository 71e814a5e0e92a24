"""Token counts under a unigram vocabulary, without making the tokens.

The vocabulary and scores come from a SentencePiece file; spaces become U+2581, each word starts with one (a first word
always), and no piece crosses a word's start. In a word an Aho-Corasick automaton gives all pieces ending at each
place, and dynamic programming keeps the best score and its number of pieces for each place. The rules are those of the
tokenizers library's unigram model: sums of 64-bit floats from the word's start; of equal sums the one whose last piece
starts earliest wins; a character with no piece of its own may also stand as unknown, at the lowest score less 10, and
counts as its UTF-8 bytes where the vocabulary has byte pieces (else a run of unknown characters counts as one).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from leafmill.llm.common import held, only, scan, tokenizer_path
from leafmill.llm.words import Store, binary_array, distinct, sums, text_bytes

SPACE = "▁"


def vocabulary(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.a = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.a.add_word(piece, (len(piece), score))
        self.a.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - 10.0
        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.store = Store(self.fill, "<f8")

    def word(self, w: str) -> tuple[int, float]:
        """Number of pieces and score of one word."""
        n = len(w)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for e, x in self.a.iter(w):
            ends[e].append(x)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for e in range(n):
            top, k, u = None, 0, False
            for m, s in sorted(ends[e], key=lambda x: -x[0]):  # the earliest start first; only a better sum replaces it
                v = best[e + 1 - m] + s
                if top is None or v > top:
                    top, k = v, count[e + 1 - m] + 1
            if w[e] not in self.single:
                v = best[e] + self.unknown
                if top is None or v > top:
                    # neighbouring unknown characters are one piece, unless they fall into bytes
                    more = len(w[e].encode("utf-8", "replace")) if self.bytes else 0 if unknown[e] else 1
                    top, k, u = v, count[e] + more, True
            best[e + 1], count[e + 1], unknown[e + 1] = top, k, u
        return count[n], best[n]

    def fill(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.word(SPACE + w.removeprefix(b" ").decode("utf-8", "replace")) for w in words]
        return np.array(got, np.float64).reshape(-1), np.full(len(got), 2)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of pieces and score of each text."""
        raw, at = text_bytes(pc.replace_substring(texts, SPACE, " "))
        start = raw == 32
        start[at[:-1][at[:-1] < len(raw)]] = True
        begin = np.flatnonzero(start)
        words, which = distinct(binary_array(raw, np.append(begin, len(raw))))
        got, per = self.store.rows(words, 2)[which], np.diff(np.searchsorted(begin, at))
        return sums(got[:, 0], per).astype(np.int64), sums(got[:, 1], per)


def counter(path: str) -> UnigramCounter:
    return held(f"unigram {path}", lambda: UnigramCounter(vocabulary(path)))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, best_score of each row.

    Null and empty texts have 0 tokens. Repeated rows each get their row; an empty table gives none; a null doc_id
    stays null; other columns are ignored. One pass, nothing is shuffled; a worker keeps a bounded number of words.
    """
    at = path or tokenizer_path("piece_bpe_32k.model")

    def one(b: pa.RecordBatch) -> dict:
        n, s = counter(at).texts(b.column("text"))
        return {"doc_id": b.column("doc_id"), "n_tokens": n, "best_score": s}

    return scan(only(docs, "doc_id", "text"), "doc_id bigint, n_tokens bigint, best_score double", one)
