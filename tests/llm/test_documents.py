"""Deduplication, filters and shards against plain models and planted cases."""

import collections
import functools
import hashlib
import itertools
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import decontam, fingerprint, langid, linedup, minhash, sharding, toxicity

@functools.cache
def library():
    from tokenizers import Tokenizer

    from leafmill.llm.common import tokenizer_path

    return Tokenizer.from_file(tokenizer_path())


WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu", "nu", "xi", "omi", "pi", "rho", "sigma", "tau", "ups"]


def table(spark, texts, ids=None):
    rows = [(i, t, "clash", 7, 1.0) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, key string, n int, score double")


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_copies(seed=4):
    r = random.Random(seed)
    out = [None, "", "  \n\t", "one two", "ONE two", "one  two", "ÉCOLE one two three four", "école one two three four"]
    common = prose(r, 60)
    for _ in range(12):
        base = prose(r, r.randint(20, 120)).split()
        for _ in range(r.randint(1, 5)):
            x = list(base)
            for _ in range(r.randint(0, 2)):
                x[r.randrange(len(x))] = "changed" + str(r.randint(0, 9))
            out.append(" ".join(x))
    return out + [common + " " + prose(r, 40) for _ in range(15)] + ["same words here now again"] * 9


@pytest.mark.parametrize("hot", [20_000, 6])
def test_near_groups_equal_brute_force(spark, hot):
    texts = near_copies()
    got = {r["doc_id"]: r for r in minhash.near_groups(table(spark, texts), hot=hot).collect()}
    s = [sets(t) for t in texts]
    root = list(range(len(s)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(s[i]), find(i), find(i) == i) for i in range(len(s))}


def star(copies, words=304, seed=3):
    """Copies of one base, each with its own run of changed words: 0.86 like the base, less like each other; the base's id is the largest."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**9)}" for _ in range(words)]
    out = []
    for i in range(copies):
        x, at = list(base), r.randrange(5, words - 25)
        x[at : at + 18] = [f"c{i}x{k}" for k in range(18)]
        out.append(" ".join(x))
    return [*out, " ".join(base)]


@pytest.mark.parametrize("hot,base_first", [(20_000, False), (100, True)])
def test_copies_of_one_base_are_all_found(spark, hot, base_first):
    texts = star(600)
    ids = [*range(1, 601), 0] if base_first else None
    got = minhash.near_groups(table(spark, texts, ids), hot=hot).collect()
    base, s = sets(texts[-1]), [sets(t) for t in texts]
    assert all(100 * len(x & base) >= 85 * len(x | base) for x in s)
    assert {r["component_id"] for r in got} == {0}


def test_slices_take_no_partner_from_the_smallest(spark):
    # one value agrees in all tables, the rest differ: every bucket holds all classes
    r = random.Random(5)
    sig = lambda: b"".join(bytes([r.randrange(256)]) * 4 if k % 4 else bytes(4) for k in range(28))
    rows = [(i, bytearray(bytes(8) + sig()[8:56] + bytes(8) + sig()[64:])) for i in range(60)]
    pairs = minhash.candidates(spark.createDataFrame(rows, "rep bigint, sig binary"), hot=10).collect()
    assert {x["b"] for x in pairs if x["a"] == 0} == set(range(1, 60))


def test_near_groups_of_nothing_and_repeats(spark):
    assert minhash.near_groups(table(spark, [])).count() == 0
    got = minhash.near_groups(table(spark, ["a b c", "a b c", "a b c"], [5, 5, None])).collect()
    assert sorted((r["doc_id"] is None, r["component_id"], r["kept"]) for r in got) == [(False, 5, True), (False, 5, True), (True, None, True)]


def test_texts_of_one_id_are_judged_each(spark):
    r = random.Random(7)
    a, b, c = (prose(r, 200) for _ in range(3))
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(3, a), (5, near), (5, b), (7, c), (7, b)]
    got = {(x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in minhash.near_groups(table(spark, [t for _, t in rows], [i for i, _ in rows])).collect()}
    n = [len(sets(t)) for _, t in rows]
    assert got == {(3, n[0], 3, True), (5, n[1], 3, False), (5, n[2], 5, True), (7, n[3], 7, True), (7, n[4], 5, False)}


def test_very_long_texts(spark):
    """A text of 200,000 words and its near copy, in every operator on pairs or scores."""
    r = random.Random(12)
    w = prose(r, 200_000).split()
    x = list(w)
    for i in range(0, len(x), 4000):
        x[i] = "changed"
    d = table(spark, [" ".join(w), " ".join(x), "short", None, ""])
    assert [(i["doc_id"], i["component_id"]) for i in minhash.near_groups(d).orderBy("doc_id").collect()] == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 4)]
    b = spark.createDataFrame([(0, " ".join(w[150_000:150_030]))], "item_id bigint, text string")
    assert {(i["doc_id"], i["item_id"]) for i in decontam.overlaps(d, b).collect()} == {(0, 0), (1, 0)}
    assert sharding.balanced(d).count() == 5 and linedup.line_report(d).count() == 5 and fingerprint.edited_and_next(d).count() == 5


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (150, 200)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in minhash.components(e).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {200: 100, 150: 100}


TEXTS = ["Straße  A\n", "STRASSE a", "été", "ÉTÉ", "ạ̇", "ạ̇", None, "", " 　", "x", "y", "한", "한"]


def canonical(t):
    nfc = lambda x: unicodedata.normalize("NFC", x)
    return re.sub(r"[\s\x1c-\x1f]+", " ", nfc(nfc(t or "").casefold())).strip(" ")


def test_fingerprints(spark):
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(table(spark, TEXTS)).collect()}
    want = [canonical(t) for t in TEXTS]
    for i in range(len(TEXTS)):
        for j in range(i):
            assert (got[i] == got[j]) == (want[i] == want[j]), (i, j)


def test_a_shared_bucket_is_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "digest", lambda c: F.substring(F.concat(c, F.lit("_")), 1, 1))
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(table(spark, ["aa", "ab", "AA", "b"])).collect()}
    assert got[0] == got[2] != got[1] and len(got[0]) == 65 and got[3] == "b"


@pytest.mark.parametrize("ids", [None, [7, 3, 3, 1, 90, 20, 21, 22, 23, 24, 25, 26, 1000000]])
def test_edited_texts(spark, ids):
    d = table(spark, TEXTS, ids)
    got = fingerprint.edited_and_next(d, parts=5).collect()
    order = sorted(((i, t or "") for i, t in zip(ids or range(len(TEXTS)), TEXTS)), key=lambda x: x[0])
    if ids is None:
        nxt = [t for _, t in order[1:]] + [order[0][1]]
        want = {i: hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest() for (i, t), n in zip(order, nxt)}
        assert {r["doc_id"]: r["edited_sha256"] for r in got} == want
        assert all(r["near_edited"] in (0.0, 1.0) for r in got)
    assert len(got) == len(TEXTS) and sorted(r["n_chars"] for r in got) == sorted(len(t) for _, t in order)
    assert fingerprint.edited_and_next(table(spark, [])).count() == 0
    one = fingerprint.edited_and_next(table(spark, ["abcd"])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_lines(spark):
    p = "one\ntwo\nthree\nfour"
    texts = [f"a\n{p}\nb", f"c\n{p}\nd", p, "x\ny", "x\ny", None, "", "q\nq\nq\nq\nq"]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linedup.dedup_lines(table(spark, texts)).collect()}
    assert got == {0: (texts[0], 0), 1: ("c\nd", 4), 2: ("", 4), 3: ("x\ny", 0), 4: ("x\ny", 0), 5: (None, 0), 6: ("", 0), 7: ("q", 4)}
    assert linedup.dedup_lines(table(spark, texts)).columns[:5] == ["doc_id", "text", "key", "n", "score"]
    assert linedup.dedup_lines(table(spark, [])).count() == 0


def test_lines_of_texts_that_share_an_id(spark):
    rows = [(0, "a\nb\nc"), (1, "a\nb\nc\nx"), (1, "p\nq\nr\ns"), (1, "p\nq\nr\ns"), (2, "p\nq\nr\nt"), (None, "a\nb\nc"), (None, None)]
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in linedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr)
    assert got == sorted([(0, "a\nb\nc", 0), (1, "x", 3), (1, "p\nq\nr\ns", 0), (1, "p\nq\nr\ns", 0), (2, "t", 3), (None, "a\nb\nc", 0), (None, None, 0)], key=repr)


@pytest.mark.parametrize("texts", [[], ["same"] * 200 + ["x" * i for i in range(60)], [None, "", "a"], [f"text {i} " * (i % 9 + 1) for i in range(400)]])
def test_shards(spark, texts):
    got = sharding.balanced(table(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["tokens"] == len(library().encode(texts[r["doc_id"]] or "").ids)
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and 0 <= s < 8
    if len(texts) == 400:
        sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
        assert max(sizes) - min(sizes) <= max(r["size"] for r in got)
        for c in ("tokens", "rows"):
            loads = [sum(r[c] if c == "tokens" else 1 for r in got if r["shard"] == s) for s in range(8)]
            assert max(loads) <= 1.15 * sum(loads) / 8, c
        assert all(len({r["shard"] for r in got if texts[r["doc_id"]] == t}) == 1 for t in texts)


def test_a_group_is_cut_only_beyond_a_shard(spark):
    rows = ["big " * 100] * 70 + [f"text {i} " * 50 for i in range(1000)]
    got = sharding.balanced(table(spark, rows)).collect()
    assert len({r["shard"] for r in got if r["doc_id"] < 70}) == 1 and {r["group_parts"] for r in got} == {1}
    rows = ["big " * 100] * 700 + [f"text {i} " * 50 for i in range(1000)]
    got = sharding.balanced(table(spark, rows)).collect()
    assert {r["group_parts"] for r in got if r["doc_id"] < 700} == {4} and len({r["shard"] for r in got if r["doc_id"] < 700}) == 4


def test_placement_by_the_dot_product():
    r = np.random.default_rng(2)
    loads, free = r.random((60, 3)) / 60, np.full((5, 3), 0.2)
    left, got = free.copy(), sharding.place(loads, free)
    for v, k in zip(loads, got):
        dots = [sum(w * a * b for w, a, b in zip(sharding.WEIGHTS, row, v)) for row in left]
        assert dots[k] == pytest.approx(max(dots))
        left[k] -= v


def test_language(spark):
    r = random.Random(2)
    vocab = {"aa": ["the", "and", "house", "water"], "bb": ["der", "und", "haus", "wasser"], "cc": ["eau", "maison", "les", "des"]}
    rows = [(i, " ".join(r.choice(vocab[k]) for _ in range(12)), k) for i, k in enumerate(list(vocab) * 60)]
    d = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 ++ 3", "bb"), (902, "Wasserhaus!", None), (903, "", "cc")], "doc_id bigint, text string, lang string")
    got = {x["doc_id"]: x for x in langid.identify(d).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows) and all(0 <= x["score"] <= 1 for x in got.values())
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "bb", "und"]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert langid.identify(d.where("lang = 'none'")).count() == 0
    assert {x["lang_pred"] for x in langid.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_small_languages_and_long_words_are_learned(spark):
    """Seventy languages, one of them tiny, one of words of over sixty characters."""
    r = random.Random(3)
    sign = [chr(0x4E00 + 40 * k) for k in range(70)]
    rows = [(k * 100 + i, " ".join(sign[k] + r.choice(WORDS) for _ in range(12)), f"l{k:02}") for k in range(70) for i in range(6 if k == 69 else 10)]
    rows += [(8000 + i, " ".join("".join(chr(0x3041 + r.randrange(30)) for _ in range(90)) for _ in range(3)), "long") for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {x["doc_id"]: x["lang_pred"] for x in langid.identify(d).collect()}
    assert got == {i: k for i, _, k in rows}
    assert langid.recognised(d.withColumn("lang", F.lit(None).cast("string"))).count() == len(rows)


def test_toxicity(spark):
    r = random.Random(6)
    rows, marks = [], []
    for i in range(500):
        bad = i % 4 == 0
        w = [r.choice(WORDS) + r.choice(WORDS) for _ in range(40)]
        if bad:
            w[r.randrange(40)] = r.choice(["vilething", "vilestuff"])
            w[r.randrange(40)] = "vile" + r.choice(WORDS)
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    d = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id bigint, text string")
    m = spark.createDataFrame(marks + [(2, None)], "doc_id bigint, toxic int")
    whole = {x["doc_id"]: x for x in toxicity.score(d, m).collect()}
    y = dict(marks)
    held = [i for i in whole if whole[i]["held_out"] and i in y]
    assert sum(whole[i]["predicted"] == y[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= x["score"] <= 1 for x in whole.values()) and whole[1000]["score"] == whole[1001]["score"]
    none = {x["score"] for x in toxicity.score(d, m.where("toxic = 0")).collect()}
    assert none == {0.5}


def test_every_character_of_a_long_run_counts(spark):
    assert toxicity.expressions("Good/vile-x, f*ck…don't_go 12 ".encode()) == ["good", "vile", "x", "f*ck", "don't", "go"]
    assert toxicity.expressions(b"ab" * 30) == ["ab" * 12, "ab" * 12, "ab" * 6]
    rows = [(i, " ".join(random.Random(i).choices(WORDS, k=30)) + (" vileword" if i % 2 else "")) for i in range(200)]
    d = spark.createDataFrame([*rows, (900, "alpha/beta/gamma/delta/vileword"), (901, "alpha/beta/gamma/delta/epsilon")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")).collect()}
    assert got[900] > 0.5 > got[901]


def test_toxicity_blocks_agree(spark):
    d = spark.createDataFrame([(i, "vile words and others é " * (i % 3 + 1)) for i in range(30)], "doc_id bigint, text string")
    m = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id bigint, toxic int")
    t = toxicity.steps(toxicity.word_counts(d.join(m, "doc_id")), rare=1)
    one, many = ([tuple(r) for r in toxicity.features(d, t, b).orderBy("doc_id").collect()] for b in (10**6, 5))
    assert [r[:2] for r in one] == [r[:2] for r in many] and all(a[2] == pytest.approx(b[2], abs=1e-6) for a, b in zip(one, many))


def test_decontamination(spark):
    r = random.Random(8)
    items = [prose(r, n) for n in (9, 15, 30, 60)] + ["too short"]
    b = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, items[1]), (91, None), (None, "x")], "item_id bigint, text string")

    def swapped(t, k):
        w = t.split()
        for i in range(2, len(w), k):
            w[i] = "other"
        return " ".join(w)

    clean = [prose(r, 200) for _ in range(20)]
    bad = [f"{prose(r, 50)} {x} {prose(r, 20)}" for x in (items[0], items[1].upper(), swapped(items[2], 6), swapped(items[3], 5), ", ".join(items[1].split()))]
    d = table(spark, clean + bad + [None, "", items[2] + " " + items[2]])
    got = {(x["doc_id"], x["item_id"]) for x in decontam.overlaps(d, b).collect()}
    assert got == {(20, 0), (21, 1), (22, 2), (23, 3), (24, 1), (27, 2)}
    assert {x["doc_id"] for x in decontam.clean(d, b).collect()} == {*range(20), 25, 26}
    assert decontam.overlaps(d, b.where("item_id < 0")).count() == 0 and decontam.overlaps(table(spark, []), b).count() == 0


@pytest.mark.parametrize("n,off", [(8, 1), (8, 2), (9, 2), (10, 2), (12, 3), (15, 3), (16, 4), (20, 5)])
def test_every_accepted_pattern_is_found(n, off):
    item, before = np.arange(1, n + 1, dtype=np.uint64), np.arange(500, 503, dtype=np.uint64)
    block = decontam.Block([7], [item])
    for k, places in enumerate(itertools.combinations(range(n), off)):
        x = item.copy()
        x[list(places)] = 10_000 + np.arange(off, dtype=np.uint64)
        assert [0, 3] in block.hits(np.concatenate([before, x])).tolist(), places
    assert block.overlaps(np.concatenate([before, x]), np.array([0, n + 3]), np.array([[0, 3]]), 20, 0.75, 8) == {(0, 0): (n - off, n)}


def test_blocks_give_the_same_rows(spark):
    r = random.Random(11)
    items = [prose(r, 12), prose(r, 30)]
    b = spark.createDataFrame([(1, items[0]), (2, items[1]), (3, items[0]), (4, items[1].upper())], "item_id bigint, text string")
    d = table(spark, [prose(r, 300) + " " + items[0], items[1], items[0], items[0], prose(r, 5000) + " " + items[1]])
    rows = [sorted(map(tuple, decontam.overlaps(d, b, block_words=n).collect())) for n in (10**6, 1)]
    assert rows[0] == rows[1] and {(x[0], x[1]) for x in rows[0]} == {(0, 1), (1, 2), (2, 1), (3, 1), (4, 2)}


def overlaps_by_brute_force(docs, items):
    """(doc_id, item_id, n_same, n_compared) of every item, by comparing it at every place of every document."""
    words = lambda t: [x.encode() for x in re.findall(r"\w+", (t or "").lower())]
    least_id = {}
    for i, t in items:
        if i is not None and words(t):
            least_id[tuple(words(t))] = min(i, least_id.get(tuple(words(t)), i))
    out = []
    for d, t in docs:
        h = words(t)
        if d is None or not h:
            continue
        for x, i in least_id.items():
            need = min(len(x), 20)
            best = 0
            for shift in range(-len(x) + 1, len(h)):
                same = [0 <= k + shift < len(h) and h[k + shift] == w for k, w in enumerate(x)]
                best = max(best, max(sum(same[k : k + need]) for k in range(len(x) - need + 1)))
            if best >= (0.75 if len(x) >= 8 else 1) * need:
                out.append((d, i, best, need))
    return sorted(out)


def test_overlaps_equal_brute_force(spark):
    r = random.Random(21)
    few = ["ja", "nein", "so"]
    items = [(i, " ".join(r.choice(few if i % 2 else WORDS) for _ in range(r.choice([1, 3, 8, 9, 20, 21, 35])))) for i in range(14)]
    items += [(50, "ja " * 30), (51, "ja nein " * 12), (52, "JA " * 30), (53, None), (None, "ja ja ja ja ja ja ja ja"), (54, "...")]
    docs = [(i, " ".join(r.choice(few if i % 2 else WORDS) for _ in range(r.randint(0, 70)))) for i in range(14)]
    for i in range(10):
        x = r.choice(items[:14])[1].split()
        for _ in range(r.randint(0, len(x) // 4)):
            x[r.randrange(len(x))] = "other"
        docs.append((30 + i, f"{prose(r, r.randint(0, 5))} {' '.join(x)} {prose(r, 3)}"))
    docs += [(60, "ja " * 90), (61, "nein ja " * 40), (62, "ja " * 10 + "so " + "ja " * 25), (63, ""), (64, None), (None, items[2][1]), (65, "ja " * 14)]
    got = decontam.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_words=120)
    assert sorted(map(tuple, got.collect())) == overlaps_by_brute_force(docs, items)


def test_slices_change_nothing(monkeypatch):
    r = np.random.default_rng(3)
    items = [r.integers(1, 4, n).astype(np.uint64) for n in (8, 20, 33, 50, 90)] + [np.full(40, 2, np.uint64)]
    h = np.concatenate([r.integers(1, 4, 300), np.full(60, 2), np.tile([1, 2], 40)]).astype(np.uint64)
    at = np.array([0, 111, 111, 300, len(h)])

    def run():
        block = decontam.Block(list(range(6)), items)
        found = block.hits(h)
        return sorted(map(tuple, found.tolist())), block.overlaps(h, at, found, 20, 0.75, 8)

    whole = run()
    # every pair of places, one by one
    block, by = decontam.Block(list(range(6)), items), collections.Counter()
    for m in block.used:
        for i, x in enumerate(items):
            for p, s in enumerate(decontam.seeds(h, m)):
                by.update((i, p - q) for q, t in enumerate(decontam.seeds(x, m)) if s == t)
    assert whole[0] == sorted(k for k, n in by.items() if n >= block.least_seeds[k[0]])
    monkeypatch.setattr(decontam, "SLICE", 7)
    assert run() == whole


def test_repeated_words_take_little_memory():
    """An item of 1,000 and a document of 200,000 equal words, in a process of its own."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from leafmill.llm import decontam
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
block = decontam.Block([1], [np.full(1000, 77, np.uint64)])
h = np.full(200_000, 77, np.uint64)
found = block.hits(h)
got = block.overlaps(h, np.array([0, len(h)]), found, 20, 0.75, 8)
assert got == {(0, 0): (20, 20)} and len(found) > 199_000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, timeout=300, check=True)
    assert int(out.stdout) < 300


def test_excerpts_at_document_edges_and_short_items(spark):
    r = random.Random(9)
    w = [f"w{i}" for i in range(40)]
    items = [" ".join(w), "seven short words that must agree wholly", "two words", "one"]
    b = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    filler = prose(r, 30)
    docs = [" ".join(w[10:25]), filler + " " + " ".join(w[:15]), " ".join(w[-16:]) + " " + filler, " ".join(w[10:24]), filler + " Seven short words, that must agree wholly", "seven short words that may agree wholly", "two, words", "One", filler]
    got = {(x["doc_id"], x["item_id"], x["n_same"]) for x in decontam.overlaps(table(spark, docs), b).collect()}
    assert got == {(0, 0, 15), (1, 0, 15), (2, 0, 16), (4, 1, 7), (6, 2, 2), (7, 3, 1)}


def test_small_table_has_all_its_links(spark):
    """The documents of the small test table, with links found by brute force through an index of shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    s = {i: sets(t) for i, t in rows}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = {}
    for i, x in s.items():
        for g in x:
            held.setdefault(g, []).append(i)
    together = {}
    for ids in held.values():
        for i, j in itertools.combinations(ids, 2):
            together[i, j] = together.get((i, j), 0) + 1
    links = [(i, j) for (i, j), n in together.items() if 100 * n >= 85 * (len(s[i]) + len(s[j]) - n)]
    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    assert links and {r["doc_id"]: r["component_id"] for r in minhash.near_groups(docs).collect()} == {i: find(i) for i in s}


def test_language_scores_equal_a_plain_model(spark):
    """Words by their shares, unseen ones by the mean of their longest known n-grams, on a small sample."""
    r = random.Random(21)
    rows = [(i, " ".join(r.choice(WORDS)[: r.randint(1, 6)] + ("o" if i % 2 else "e") for _ in range(8)), "ab"[i % 2]) for i in range(60)]
    known = [(t, k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    counts = {k: {} for k in "ab"}
    for t, k in known:
        for w in t.split():
            counts[k][w] = counts[k].get(w, 0) + 1
    tables = [counts, *({k: {} for k in "ab"} for _ in range(langid.LONGEST))]
    for k, c in counts.items():
        for w, n in c.items():
            p = f" {w} "
            for m in range(1, langid.LONGEST + 1):
                for i in range(len(p) - m + 1):
                    tables[m][k][p[i : i + m]] = tables[m][k].get(p[i : i + m], 0) + n**0.5

    def value(m, g):
        total = {k: sum(tables[m][k].values()) + langid.DAMP for k in "ab"}
        return [np.log1p(tables[m][k].get(g, 0) / total[k] * max(total.values()) / langid.FLOOR) for k in "ab"]

    def word(w):
        if any(w in c for c in counts.values()):
            return value(0, w)
        p = f" {w} "
        for m in range(langid.LONGEST, 0, -1):
            grams = [p[i : i + m] for i in range(len(p) - m + 1) if any(p[i : i + m] in tables[m][k] for k in "ab")]
            if grams:
                return np.mean([value(m, g) for g in grams], axis=0)
        return [0.0, 0.0]

    texts = ["alphae betao", "zzzz", "gamme gammo gam", "alphaoalphae 12 (beto)", "ome" * 40]
    d = spark.createDataFrame([*rows, *((1000 + i, t, None) for i, t in enumerate(texts))], "doc_id bigint, text string, lang string")
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.identify(d).collect()}
    for i, t in [(i, t) for i, t, _ in rows] + [(1000 + i, t) for i, t in enumerate(texts)]:
        v = [word(w) for w in map(langid.letters, t.lower().split()) if w]
        mean = np.mean(v, axis=0)
        e = np.exp((mean - mean.max()) * min(len(v), langid.CERTAIN))
        assert got[i][0] == "ab"[int(mean.argmax())] or abs(mean[0] - mean[1]) < 1e-6, t
        assert got[i][1] == pytest.approx(e.max() / e.sum(), abs=1e-5), t


def test_word_values_equal_a_plain_model(spark):
    """The two classes' probabilities of words, character by character, from counts of beginnings."""
    r = random.Random(5)
    make = lambda bad: " ".join(r.choice(["vile", "vilest", "vim", "good", "goose"]) if r.random() < (0.4 if bad else 0.05) else r.choice(WORDS) for _ in range(30))
    rows = [(i, make(i % 2), i % 2) for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    table = toxicity.steps(toxicity.word_counts(d), rare=2)
    n, types = ({}, {}), {}
    for _, t, y in rows:
        for w in t.split():
            for k in range(len(w) + 2):
                b = (w + "\n")[:k]
                n[y][b] = n[y].get(b, 0) + 1
    for w in {w for _, t, _ in rows for w in t.split()}:
        for k in range(len(w) + 2):
            types[(w + "\n")[:k]] = types.get((w + "\n")[:k], 0) + 1
    kids = {}
    for b in types:
        if b:
            kids.setdefault(b[:-1], []).append(b)

    def p(y, b, x):
        shared = (types[b + x] + 1) / (types[b] + len(kids[b]) + 1)
        if not n[y].get(b):
            return shared
        return (max(n[y].get(b + x, 0) - toxicity.D, 0) + toxicity.D * sum(c in n[y] for c in kids[b]) * shared) / n[y][b]

    got = {x["begin"]: x["value"] for x in table.where(~F.endswith("begin", F.lit("\n\n"))).collect()}
    want = {b: np.log(p(1, b[:-1], b[-1])) - np.log(p(0, b[:-1], b[-1])) for b in types if b and n[1].get(b[:-1], 0) >= 2}
    assert set(got) >= set(want) and all(got[b] == pytest.approx(v, abs=1e-9) for b, v in want.items())
    per = {x["doc_id"]: x for x in toxicity.features(d.drop("toxic"), table).collect()}
    for i, t, _ in rows:
        v = [sum(want[(w + "\n")[:k]] for k in range(1, len(w) + 2)) if all((w + "\n")[:k] in want for k in range(1, len(w) + 2)) else None for w in t.split()]
        if None not in v:
            assert per[i]["total"] == pytest.approx(sum(v), abs=1e-3) and per[i]["above"] == pytest.approx(sum(max(x - toxicity.NOISE, 0) for x in v), abs=1e-3)


CLASHES = "doc_id bigint, text string, lang string, key string, word string, h bigint, n int, t int, begin string, score double, toxic int, shard int, part int, gone int, _lines string"


def test_clashing_columns_repeats_ties_and_nothing(spark):
    r = random.Random(31)
    texts = [prose(r, 40) + " vile" * (i % 2) for i in range(12)]
    rows = [(i, t, "ab"[i % 2], "k", "w", 1, 2, 3, "b", 0.5, 1, 2, 3, 4, "l") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "null id", None, *rows[0][3:]), (50, None, "a", *rows[0][3:]), (51, "", "b", *rows[0][3:])]
    d, labels = spark.createDataFrame(rows, CLASHES), spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    bench = spark.createDataFrame([(1, texts[5])], "item_id bigint, text string")
    none, no_bench, no_labels = d.limit(0), bench.limit(0), labels.limit(0)
    asked = {
        "op1": lambda x: minhash.near_groups(x), "op2": lambda x: fingerprint.edited_and_next(x), "op5": lambda x: toxicity.score(x, labels), "op6": lambda x: sharding.balanced(x),
        "op7": lambda x: linedup.line_report(x), "op8": lambda x: langid.identify(x),
    }
    for name, f in asked.items():
        got = f(d).collect()
        assert len(got) == len(rows), name
        same = [tuple(v for k, v in x.asDict().items() if k not in ("slot", "edited_sha256", "edited_fingerprint", "near_edited", "near_next")) for x in got if x["doc_id"] == 0]
        assert len(same) == 3 and len(set(same)) == 1, name
        assert f(none).count() == 0, name
    assert sorted(x["doc_id"] for x in decontam.overlaps(d, bench).collect()) == [5] and decontam.overlaps(d, no_bench).count() == 0
    assert decontam.clean(d, bench).count() == len(rows) - 1 and decontam.clean(none, bench).count() == 0
    assert {x["score"] for x in toxicity.score(d, no_labels).collect()} == {0.5}


def test_only_labelled_texts_are_shuffled(spark, monkeypatch):
    r = random.Random(5)
    texts = [prose(r, 20) for _ in range(400)]
    docs, marks = table(spark, texts), spark.createDataFrame([(i, i % 2) for i in range(0, 400, 40)], "doc_id bigint, toxic int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = toxicity.labelled(docs.select("doc_id", "text"), marks)
        assert "BroadcastHashJoin" in few._jdf.queryExecution().toString() and sorted(x["doc_id"] for x in few.collect()) == list(range(0, 400, 40))
        monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 3)
        many = toxicity.labelled(docs.select("doc_id", "text"), marks)
        assert {(x["doc_id"], x["text"], x["toxic"]) for x in many.collect()} == {(x["doc_id"], x["text"], x["toxic"]) for x in few.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    from leafmill.llm.common import maybe_among

    kept = {x["doc_id"] for x in maybe_among(docs, marks, "doc_id").collect()}
    assert kept >= set(range(0, 400, 40)) and len(kept) < 20
    assert maybe_among(docs, marks.limit(0), "doc_id").count() == 0


def test_a_class_is_sent_to_a_bounded_number_of_blocks(spark):
    n = [1, 512, 513, 4096, 32_768, 100_000, 4_000_000]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in n], "n bigint").select(minhash.block_count(F.col("n"))).collect()]
    assert got == [1, 1, 2, 8, 64, 64, 64]


def test_staged_tables_go(spark):
    import os

    from leafmill.llm import common

    mark = common.staged()
    a, b = common.stage(spark.range(3), "a"), common.stage(spark.range(4), "b")
    folder = a._leafmill_path
    assert os.path.isdir(folder)
    common.unstage(a)
    assert not os.path.isdir(folder) and b.count() == 4 and common.staged() == mark + 1
    common.clear(spark, mark)
    assert common.staged() == mark and not os.path.isdir(b._leafmill_path)
