"""Token ids, token files, packing and counts against the libraries and plain models."""

import functools
import heapq
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import packing, tokenbin, tokencount, tokens, words
from leafmill.llm.common import tokenizer_path

ODD = ["", None, " ", "a", "a  b", "a \n b", "\n\n", "tab\tx", "a\x1fb\x00c", "　 x", "é\nÉ <|endoftext|>\nz", "it's 'll we'll 12a.", "日本語 ☃☃ mixed", "x" * 5000, "word " * 3000 + "end"]


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def whole(text):
    return library().encode(text or "", add_special_tokens=False).ids


def docs(spark, texts=ODD, **more):
    rows = [(i, t, "z", 0, b"") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, shard int, bits binary")


SIGNS = ["a", "Zq", " ", "  ", "\n", "\n\n", "\t", " \n", "1", "42", "'s", "'", "’s", "é", "É", "ß", "×", "÷", "ª", "²", "½", "\xa0", "\u2003", "\u3000", "\x85", "\x1c", "\x1f", "\x00", "漢字", "ж", "Ω", "\u0301", "!?", "$$$", "<|endoftext|>", "<|endo", "😀", "\u200b", "\ufeff", "\r\n", "\x0b", "ɏ", "ɐ", "ʰ", "_", "…"]


def encoded(texts):
    ids, n = tokens.bpe(tokenizer_path()).encode(pa.array(texts, pa.string()))
    at = np.concatenate([[0], np.cumsum(n)])
    return [ids[i:j].tolist() for i, j in zip(at, at[1:])]


def test_words_equal_whole_texts():
    r = random.Random(1)
    made = ["".join(r.choice(["the", "réeux", " ", " ", "\n", ".", "Ab9", "'s", "ß", "日", "\t", ",", "  "]) for _ in range(40)) for _ in range(300)]
    made += ["".join(r.choice(SIGNS) for _ in range(r.randrange(14))) for _ in range(20_000)]
    assert encoded(made + ODD) == [whole(t) for t in made + ODD]
    assert encoded([]) == [] and encoded(["", None]) == [[], []]


def test_a_full_store_starts_anew():
    s = words.Store(lambda ws: (np.concatenate([[len(w)] * len(w) for w in ws]), [len(w) for w in ws]), "<u4", most=300)
    for _ in range(3):
        for k in range(40):
            ws = [b"x" * (1 + (k + j) % 9) for j in range(5)]
            flat, start, count = s.find(ws)
            assert [flat[i : i + n].tolist() for i, n in zip(start, count)] == [[len(w)] * len(w) for w in ws]
        s.clear()
    s = words.Store(lambda ws: (np.arange(len(ws)), [1] * len(ws)), "<i8", most=100)
    s.find([b"%d" % i for i in range(50)])
    s.find([b"a"])
    assert len(s.k1) == 1


def test_code_widths_are_best_and_limited():
    def huffman_cost(c):
        h = list(c)
        heapq.heapify(h)
        cost = 0
        while len(h) > 1:
            x = heapq.heappop(h) + heapq.heappop(h)
            cost += x
            heapq.heappush(h, x)
        return cost

    r = np.random.default_rng(0)
    for _ in range(40):
        c = r.integers(1, 90, r.integers(2, 60))
        w = tokenbin.code_widths(c)
        assert (c * w).sum() == huffman_cost(c.tolist()) and (2.0 ** -w.astype(float)).sum() == 1
    w = tokenbin.code_widths(np.array([2**k for k in range(25)]), 6)
    assert w.max() == 6 and (2.0 ** -w.astype(float)).sum() <= 1


def test_file_round_trip(spark, tmp_path):
    path = str(tmp_path / "f")
    tokenbin.write(docs(spark), path)
    got = sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in tokenbin.read(spark, path).collect())
    want = [(i, whole(t) + [2]) for i, t in enumerate(ODD)]
    assert got == want
    start = 0
    for r, (i, ids) in zip(sorted(tokenbin.index(spark, path).collect()), want):
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_empty_file(spark, tmp_path):
    tokenbin.write(docs(spark, []), str(tmp_path / "f"))
    assert tokenbin.index(spark, str(tmp_path / "f")).count() == 0


def test_repeated_rows_and_null_id(spark, tmp_path):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id bigint, text string")
    tokenbin.write(d, str(tmp_path / "f"))
    got = sorted(((r["doc_id"] is not None, r["start"]) for r in tokenbin.index(spark, str(tmp_path / "f")).collect()))
    assert [x for _, x in got] == [0, 2, 5]


def test_packing_is_sound(spark):
    got = packing.best_fit(docs(spark), most=64).toPandas()
    for i, t in enumerate(ODD):
        ids = whole(t) + [2]
        p = got[got.doc_id == i].sort_values("piece")
        assert p.length.sum() == len(ids) and p.start.tolist() == [0, *p.length.cumsum().tolist()[:-1]] and (p.length.tolist()[1:] == [64] * (len(p) - 1))
        assert p.ids_crc32.tolist() == [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for s, n in zip(p.start, p.length)]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 64
    assert packing.best_fit(docs(spark, [])).count() == 0


def test_sum_of_squares_choice():
    """Every placement is the best one by brute force over all open sequences."""
    r = np.random.default_rng(3)
    lengths = np.sort(r.integers(1, 33, 200))[::-1]
    seq, off = packing.sum_of_squares(lengths, 32)
    fill: dict[int, int] = {}

    def squares(f):
        gaps = [32 - x for x in f.values() if x < 32]
        return sum(gaps.count(g) ** 2 for g in set(gaps))

    for n, q, o in zip(lengths.tolist(), seq.tolist(), off.tolist()):
        options = [k for k, x in fill.items() if x + n <= 32]
        assert (q in fill) == bool(options) and fill.get(q, 0) == o
        if options:
            assert squares(fill | {q: fill[q] + n}) == min(squares(fill | {k: fill[k] + n}) for k in options)
        fill[q] = o + n
    assert len(fill) <= 11 / 9 * -(-lengths.sum() // 32) + 1


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    v = tokencount.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram(v, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    texts = [x for x in ODD if x] + [" a", "  b ", "a▁b", "<unk> <s> <0x0A>", "ß" * 9]
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(docs(spark, texts + [None, ""])).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)} | {len(texts): 0, len(texts) + 1: 0}


@pytest.mark.parametrize("scores", [[("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("▁ab", -3.0), ("<unk>", 0.0)]])
def test_ties_take_the_earliest_start(scores):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram([("<unk>", 0.0), *scores[:-1]], unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    c = tokencount.UnigramCounter([("<unk>", 0.0), *scores[:-1]])
    for x in ("ab", "ba", "aab", "abab", "bb", "xy", "axyza", "x", "xx a yx", "é漢x"):
        assert c.texts(pa.array([x]))[0][0] == len(t.encode(x).ids), x


def test_repeats_null_ids_and_nothing(spark):
    d = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "x"), (2, None)], "doc_id bigint, text string")
    got = packing.best_fit(d, most=16).collect()
    assert len(got) == 4 and len({(r["sequence_id"], r["offset"]) for r in got}) == 4 and sorted(r["length"] for r in got) == [1, 2, 4, 4]
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in tokencount.token_counts(d).collect())
    assert len(got) == 4 and got[0] == got[1] and ("2", 0) in got
    assert tokencount.token_counts(d.limit(0)).count() == 0 and packing.best_fit(d.limit(0)).count() == 0


def test_texts_of_one_id_lie_in_the_files_order(spark, tmp_path):
    r = random.Random(6)
    rows = [(i // 5, " ".join(r.choice(["one", "two", "three"]) for _ in range(r.randint(0, 30)))) for i in range(60)] + [(3, "twice")] * 2 + [(None, "x"), (None, None)]
    tokenbin.write(spark.createDataFrame(rows, "doc_id bigint, text string"), str(tmp_path / "f"), shards=3)
    stored = []
    for x in sorted((tmp_path / "f/ids").glob("part-*"), key=lambda p: p.name):
        stored += spark.read.parquet(str(x)).select("shard", "doc_id", "ids_crc32", "n_ids").toPandas().itertuples(index=False)
    stored.sort(key=lambda x: x.shard)  # shards lie one after another, each in the order of its file
    at, want = 0, []
    for x in stored:
        want.append((None if x.doc_id != x.doc_id else int(x.doc_id), at, x.n_ids, x.ids_crc32))
        at += x.n_ids
    got = tokenbin.index(spark, str(tmp_path / "f")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and at == sum(len(whole(t)) + 1 for _, t in rows)
