"""The divergence audit, near-equal windows and centroids against plain models, SQL and planted cases."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from leafmill.llm import centroids, divergence, queries, windows
from leafmill.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"


# ---- audit

def audited(rows, least, top=10):
    """Plain model over (text, lang, source) rows."""
    rows = [tuple(x or "" for x in r) for r in rows]
    n, df = collections.Counter(), collections.Counter()
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        n.update((lang, source, t) for t in terms)
        df.update((lang, t) for t in set(terms))
    out = set()
    for lang in {r[1] for r in rows}:
        kept = sorted(t for (g, t), c in df.items() if g == lang and c >= least)
        sources = sorted({r[2] for r in rows if r[1] == lang})
        counts = {s: [n[lang, s, t] for t in kept] for s in sources}
        share = {s: [1 + 10**9 * (c + 2) // (sum(v) + 2 * len(kept)) for c in v] for s, v in counts.items()}
        whole = [sum(c) for c in zip(*counts.values())]
        q = [1 + 10**9 * (c + 2) // (sum(whole) + 2 * len(kept)) for c in whole]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(map(f, share[s], share[o])), o.encode(), o) for o in sources if o != s]
            terms = [(-f(a, b), t.encode(), t) for t, c, a, b in zip(kept, counts[s], share[s], q) if c > 0 and a > b]
            out |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms)[:top], 1)}
    return out


def corpus():
    r = random.Random(3)
    words = ["Alpha", "beta", "ALPHA", "été", "ÉTÉ", "x1y2", "日本", "😀a", "it's", "z_z", "\x00nul", "q" * 300]
    rows = [(" ".join(r.choice(words[: r.randint(2, 12)]) for _ in range(r.randint(0, 40))), r.choice(["en", "de", None]), r.choice(["a", "b", "ä", "😀", None, "hot", "hot", "hot"])) for _ in range(150)]
    rows += [rows[0]] * 4 + [(None, "en", "silent"), ("", "xx", "s1"), (None, "xx", "s2"), ("once", "yy", "s1"), ("beta " * 50_000, "en", "b")]
    return rows


@pytest.mark.parametrize("least", [10, 1, 1000])
def test_audit_equals_a_plain_model(spark, least):
    rows = corpus()
    df = spark.createDataFrame([(i, *r, 1, "t") for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n int, term string")
    got = [tuple(r) for r in divergence.audit(df, least).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == audited(rows, least)


def test_audit_without_rows_and_with_many_groups(spark, monkeypatch):
    schema = "doc_id bigint, text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0
    # groups too many to be broadcast give the same rows
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(corpus())], schema)
    plain = divergence.crossed
    monkeypatch.setattr(divergence, "crossed", lambda groups, terms, few: plain(groups, terms, False))
    assert {tuple(r) for r in divergence.audit(df, 3).collect()} == audited(corpus(), 3)


def test_shares_of_very_frequent_words_are_exact(spark):
    n, total = 10**14 + 7, 3 * 10**15 + 1
    df = spark.createDataFrame([(n, total, 12345)], "n bigint, total bigint, v bigint")
    from pyspark.sql import functions as F

    assert df.select(divergence.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).first()["p"] == 1 + 10**9 * (n + 2) // (total + 2 * 12345)


# ---- windows

@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def best_difference(lengths, k):
    """Smallest spread of any partition."""
    best = sum(lengths)
    for to in itertools.product(range(k), repeat=len(lengths)):
        s = [0] * k
        for n, w in zip(lengths, to):
            s[w] += n
        best = min(best, max(s) - min(s))
    return best


def test_differencing():
    def spread(lengths, k):
        root = windows.difference(np.array(lengths), k)
        s = np.bincount(np.unique(root, return_inverse=True)[1], weights=lengths)
        return s.max() - (s.min() if len(s) == k else 0), len(s)

    assert spread([8, 7, 6, 5, 4], 2) == (2, 2)  # the textbook case: differencing leaves 2
    assert spread([5], 3) == (5, 1)
    assert spread([4, 4, 4], 3) == (0, 3)
    r = random.Random(1)
    for _ in range(60):
        lengths, k = [r.randint(1, 40) for _ in range(r.randint(1, 7))], r.randint(1, 3)
        got, n = spread(lengths, k)
        assert n <= k and got >= best_difference(lengths, k) and got <= max(lengths)


@pytest.mark.parametrize("lengths", [[1024] * 3, [700] * 50, [1], [512] * 9, list(range(1, 1025)), [1023, 1, 1024, 2, 1022], []])
def test_windows_hold_what_they_may(lengths):
    w = windows.near_equal(np.array(lengths, np.int64), 1024)
    if lengths:
        s = np.bincount(w, weights=lengths)
        assert s.max() <= 1024 and (s > 0).all() and len(s) >= -(-sum(lengths) // 1024)


def test_cuts_cover_each_document():
    for most in (1024, 128, 7, 1):
        n = np.array([1, 2, 6, 7, 8, 127, 128, 129, 1023, 1024, 1025, 5000])
        for sown in (np.zeros(len(n), bool), np.ones(len(n), bool)):
            doc, start, length = windows.cut(n, sown, most)
            for i, m in enumerate(n):
                s, k = start[doc == i], length[doc == i]
                assert s[0] == 0 and (s[1:] == (s + k)[:-1]).all() and s[-1] + k[-1] == m and k.min() > 0 and k.max() <= most
            assert (length.max() <= max(windows.GRAIN, most)) and (sown.any() or len(doc) == (-(-n // most)).sum())


def check_packed(rows, texts):
    """Every id in exactly one piece, pieces of a sequence gapless, none over 1024. Repeated documents are told by start."""
    left = collections.Counter()
    whole = {i: [*library().encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts}
    for r in rows:
        ids = whole[r["doc_id"]]
        piece = ids[r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and r["doc_tokens"] == len(ids)
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"]
        left.update((r["doc_id"], k) for k in range(r["start"], r["start"] + r["length"]))
    times = collections.Counter(i for i, _ in texts)
    assert left == collections.Counter({(i, k): times[i] for i in whole for k in range(len(whole[i]))})
    for _, g in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in g:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


@pytest.mark.parametrize("group", [12_000, 40])
def test_near_equal_windows(spark, group):
    r = random.Random(2)
    texts = [(0, None), (1, ""), (2, "a"), (3, "x " * 9000), (None, "no id"), (5, "again and again"), (5, "again and again")]
    texts += [(10 + i, " ".join(r.choice(["one", "two", "thirteen"]) for _ in range(r.randint(1, 900)))) for i in range(150)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id bigint, text string, length int, start int")
    rows = windows.near_equal_windows(df, group=group).collect()
    check_packed(rows, texts)
    assert windows.near_equal_windows(df.limit(0)).count() == 0


def test_lengths_that_do_not_fit_are_cut_shorter(spark):
    texts = [(i, "one " * 699) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = windows.near_equal_windows(df).collect()
    check_packed(rows, texts)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) * 1024 <= 1.02 * total


def test_padding_of_documents(spark):
    rows = queries.op12_near_equal_packing(spark, SF).collect()
    texts = [tuple(r) for r in queries.documents(spark, SF).select("doc_id", "text").collect()]
    check_packed(rows, texts)
    assert len({r["sequence_id"] for r in rows}) == -(-sum(r["length"] for r in rows) // 1024)


# ---- centroids

def clustered(vectors, k=16, rounds=3, width=64):
    """Plain model over (vec_id, vector) with Python's own integers."""
    import math

    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [r[1] for r in order[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    nearest = lambda x: min(range(len(c)), key=lambda j: (far(x, c[j]), j))
    for _ in range(rounds):
        of = [nearest(x) for _, x in kept]
        for j in set(of):
            mine = [x for (_, x), o in zip(kept, of) if o == j]
            c[j] = [sum(v) // len(mine) for v in zip(*mine)]
    rows = [(i, j := nearest(x), far(x, c[j])) for i, x in kept]
    each = collections.Counter()
    for _, j, d in rows:
        each[j] += d
    return sorted(((i, j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in rows), key=repr)


def vectors():
    r = random.Random(5)
    middle = [[r.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    out = [(i, [x + r.gauss(0, 0.05 if i % 2 else 0.8) for x in middle[i % 9]]) for i in range(400)]
    out += [(1000 + i, middle[0]) for i in range(300)] + [out[3], out[3]]  # copies, and rows that repeat an id
    out += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [1.0] * 63 + [None]), (2005, [float("nan")] + [0.0] * 63), (2006, [float("inf")] * 64), (None, [0.5] * 64), (2007, [-0.001] * 64), (2008, [9e5] * 64)]
    return out


SCHEMA = "vec_id bigint, embedding array<float>, cluster int, x string"


def test_clusters_equal_a_plain_model(spark):
    v = [(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for i, x in vectors()]
    df = spark.createDataFrame([(i, x, 3, "x") for i, x in v], SCHEMA).repartition(3)
    got = centroids.cluster(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == clustered(v)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(7, [0.25] * 64)], [(7, [0.25] * 64)] * 20, [(i, [float(i)] * 64) for i in range(5)]])
def test_few_vectors(spark, rows):
    df = spark.createDataFrame([(i, x, 0, "") for i, x in rows], SCHEMA)
    got = centroids.cluster(df).collect()
    assert sorted(map(tuple, got), key=repr) == clustered(rows)


def test_vectors_too_long_for_their_distances_are_not_kept(spark):
    df = spark.createDataFrame([(1, [3e30] * 64, 0, ""), (2, [1.0] * 64, 0, "")], SCHEMA)
    assert [r["vec_id"] for r in centroids.cluster(df).collect()] == [2]


def test_filtering_prunes_and_never_errs():
    r = np.random.default_rng(1)
    near = np.concatenate([r.integers(-3, 4, (700, 3)) + 60 * k for k in range(6)] + [np.full((333, 3), 7)])
    for x, c in ((near, near[::600][:6].copy()), (r.integers(-50, 50, (999, 64)), r.integers(-50, 50, (16, 64))), (near, np.repeat(near[:2], 3, axis=0)), (r.integers(-(2**29), 2**29, (200, 3)), r.integers(-(2**29), 2**29, (5, 3)))):
        x = x[centroids.kd_order(x)]
        owner, count, sums, done = centroids.filtered(x, c)
        of = np.where(owner < 0, -3 - owner, owner)
        true = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (of == true).all()
        for j in range(len(c)):
            inside = (owner == -3 - j)
            assert count[j] == inside.sum() and (sums[j] == x[inside].sum(axis=0)).all()
    x = near[centroids.kd_order(near)]
    done = centroids.filtered(x, near[::700][:6].copy())[3]
    assert done["whole"] > 0.9 * len(x) and done["distances"] < 0.2 * 6 * len(x)


@pytest.mark.parametrize("name", ["op7_line_dedup", "op11_source_divergence", "op13_centroids"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect()) and want


def test_terms_are_counted_before_they_leave_a_batch(monkeypatch):
    import pyarrow as pa

    texts = ["Éa b-B b", "b", None, "", "x1y", "É"]
    batch = pa.RecordBatch.from_pydict({"lang": ["l", "l", "l", "m", "l", "l"], "source": ["s", "s", "t", "s", "s", "t"], "text": pa.array(texts, pa.string())})
    want = {("l", "s", "Éa"): (1, 1), ("l", "s", "b"): (4, 2), ("l", "s", "x"): (1, 1), ("l", "s", "y"): (1, 1), ("l", "t", "É"): (1, 1)}
    for size in (divergence.SLICE_BYTES, 1):
        monkeypatch.setattr(divergence, "SLICE_BYTES", size)
        rows = [r for out in divergence._counted(iter([batch, batch.slice(0, 0)])) for r in out.to_pylist()]
        got = collections.defaultdict(lambda: (0, 0))
        for r in rows:
            k = (r["lang"], r["source"], r["term"])
            got[k] = (got[k][0] + r["n"], got[k][1] + r["docs"])
        assert {k: x for k, x in got.items() if k[2] is not None} == want
        assert {k[:2] for k in got if k[2] is None} == {("l", "s"), ("l", "t"), ("m", "s")}
        assert size == 1 or len(rows) == len(want) + 3
