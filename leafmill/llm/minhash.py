"""Near-duplicate groups: MinHash with tensored banding, links confirmed on full shingle sets.

Words are the runs of bytes between ASCII white space, with A-Z lower-cased; a document's set holds its distinct
shingles of five words (with fewer words: the whole sequence as one; without words: nothing, and it links to nothing).

Tables: two collections of ``M`` hashes, each the pair of two MinHash values. Every pair (i-th of the first, j-th of the
second) keys one of M x M tables, so ``4 M`` MinHash values serve M^2 tables of four values each. Two sets of
similarity s share a table's key somewhere with probability (1 - (1 - s^2)^M)^2: 0.9998 at s = 0.85 and M = 7.

Candidates: documents with equal sets are one class from the start. In each bucket a class is paired with the bucket's
smallest class number and with the two classes before it in the order of further MinHash values, so near copies stand side by
side even where a common passage fills a bucket; these pairs grow with the rows, never with a bucket's square. Buckets
over ``HOT`` rows are cut by that same order. Pairs that agree in too few MinHash values (``least_same``; a true link
does so with a chance of at most one in a million) are left out; the rest are joined with their full sets.

The rest: that covers every pair of buckets of up to three classes. What larger buckets may still hide is looked for in
the M larger buckets that share one hash of the first collection: where classes of different components meet, they are
compared whole, block against block inside the tasks, each pair that shares a table in the first bucket it shares. A class
is sent to one task for each block of its bucket, at most ``BLOCKS`` times: the rows that move are linear in a bucket (up to
4 million classes), its comparisons are not. Only links that join two components leave a task.

Components: alternating large-star and small-star steps on stored edge tables, until they no longer change.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import broadcast_if_small, mix, odd, only, scan_with, stage, starts_of, unstage
from leafmill.llm.words import BLANK, LOWER, distinct, runs, text_bytes, word_hashes

SHINGLE = 5
M = 7
#: Rows of a bucket beyond which it is cut in the order of further MinHash values.
HOT = 20_000
#: Classes in a bucket of which all pairs are candidates: each meets the two before it.
FEW = 3
#: About so many rows of a larger bucket are in one block; of a bucket that would have over BLOCKS of them, its BLOCKS-th part,
#: up to MOST rows. So a class is sent BLOCKS times at most, however large its bucket is.
BLOCK, BLOCKS, MOST = 512, 64, 65_536


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    raw, at = text_bytes(texts)
    words, counts = runs(LOWER[raw], at, ~BLANK)
    words, which = distinct(words)
    h = word_hashes(words)[which]
    by = odd(SHINGLE + 1, 7)
    n = len(h)
    rolled = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        if n > k:
            rolled[: n - k] += h[k:] * by[k]
    rolled = mix(rolled)
    out, at = [], starts_of(counts)
    for i, c in enumerate(counts):
        s = int(at[i])
        if c >= SHINGLE:
            out.append(np.unique(rolled[s : s + c - SHINGLE + 1]))
        elif c:
            v = np.array([c], np.uint64)
            for k in range(s, s + c):
                v = mix((v ^ h[k : k + 1]) * by[SHINGLE])
            out.append(v)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit digest of each set, in two halves."""
    n = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(n)
    g1, g2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(full):
        flat, at = np.concatenate([sets[i] for i in full]), starts_of(n[full])[:-1]
        g1[full] = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
        g2[full] = np.bitwise_xor.reduceat(mix(flat * np.uint64(0x2545F4914F6CDD1D)), at)
    return g1.view(np.int64), g2.view(np.int64)


def text_hash() -> F.Column:
    return F.xxhash64("text").alias("text_hash")


def class_id() -> F.Column:
    """The number of an equal-sets class."""
    return F.xxhash64("g1", "g2", "n_shingles")


def signatures(docs: DataFrame, m: int = M) -> DataFrame:
    """doc_id, text_hash (Spark's xxhash64 of the text), n_shingles, the set's 128-bit digest g1, g2, and its 4 m MinHash
    values (32 bits each)."""
    schema = "doc_id bigint, text_hash bigint, n_shingles bigint, g1 bigint, g2 bigint, sig binary"

    def make():
        by, plus = odd(4 * m, 101), odd(4 * m, 202)

        def one(b: pa.RecordBatch) -> dict:
            sets = shingle_sets(b.column("text"))
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            g1, g2 = digests(sets)
            sig: list[bytes | None] = [None] * len(n)
            if len(full):
                flat, at = np.concatenate([sets[i] for i in full]), starts_of(n[full])[:-1]
                low = np.stack([np.minimum.reduceat(flat * by[k] + plus[k], at) for k in range(4 * m)], axis=1)
                low = (mix(low) >> np.uint64(32)).astype("<u4")
                for i, x in zip(full, low):
                    sig[i] = x.tobytes()
            return {"doc_id": b.column("doc_id"), "text_hash": b.column("text_hash"), "n_shingles": n, "g1": g1, "g2": g2, "sig": sig}

        return one, None

    return scan_with(only(docs, "doc_id", "text", text_hash()), schema, make)


def table_rows(classes: DataFrame, m: int = M) -> DataFrame:
    """key, ord, rep: one row for each class and table. ``ord`` orders a bucket by other MinHash values."""

    def part(i: int, n: int = 4) -> F.Column:
        return F.substring("sig", i * 4 + 1, n)

    # one hash of each collection is a pair of MinHash values; the two collections are the halves of the signature
    a = F.array(*[part(2 * i, 8) for i in range(m)])
    b = F.array(*[part(2 * (m + i), 8) for i in range(m)])
    rows = classes.select("rep", a.alias("a"), b.alias("b"))
    rows = rows.select("rep", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(m * m - 1))).alias("t"))
    i, j = F.floor(F.col("t") / m).cast("int"), (F.col("t") % m).cast("int")
    key = F.xxhash64("t", F.get("a", i), F.get("b", j))
    further = F.concat(F.get("a", (i + 1) % m), F.get("b", (j + 1) % m), F.get("a", (i + 2) % m))
    return rows.select(key.alias("key"), F.conv(F.hex(F.concat(*[F.substring(further, 4 * k + 1, 1) for k in range(6)])), 16, 10).cast("bigint").alias("ord"), "rep")


def candidates(classes: DataFrame, m: int = M, hot: int = HOT) -> DataFrame:
    """Distinct pairs (a < b) of class representatives to be confirmed; staged."""
    rows = table_rows(classes, m)
    many = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("top")).where(F.col("n") > hot), "hot")
    k = many.count()
    if k:
        # equal slices of the 48-bit order, one for each ``hot`` rows
        rows = rows.join(broadcast_if_small(many, k), "key", "left")
        rows = rows.withColumn("cut", F.coalesce(F.floor(F.col("ord") / F.lit(2.0**48) * F.ceil(F.col("n") / hot)).cast("int"), F.lit(0)))
    else:
        rows = rows.withColumn("top", F.lit(None).cast("bigint")).withColumn("cut", F.lit(0))
    near = Window.partitionBy("key", "cut").orderBy("ord", "rep")
    whole = Window.partitionBy("key", "cut")
    rows = rows.select("rep", "top", F.min("rep").over(whole).alias("low"), F.lag("rep", 1).over(near).alias("p1"), F.lag("rep", 2).over(near).alias("p2"))
    rows = rows.where("low <> rep or top <> rep")
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    pairs = F.array(pair(F.col("low"), F.col("rep")), pair(F.col("p1"), F.col("rep")), pair(F.col("p2"), F.col("rep")), pair(F.col("top"), F.col("low")), pair(F.col("top"), F.col("rep")))
    full = F.filter(pairs, lambda x: x["a"] < x["b"])
    # least and greatest skip nulls, so a missing partner gives a pair of one
    out = stage(rows.select(F.explode(full).alias("e")).select("e.a", "e.b").distinct(), "pairs")
    unstage(many)
    return out


def least_same(percent: int, m: int = M) -> int:
    """MinHash values in which a pair must agree: half of them, or fewer where a true link that shares a table (four
    values) would be left out with a chance of over one in a million."""
    n, p, below, k = 4 * (m - 1), percent / 100, 0.0, 0
    while k + 4 < 2 * m and (below := below + math.comb(n, k) * p**k * (1 - p) ** (n - k)) <= 1e-6:
        k += 1
    return k + 4


def alike_enough(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    both = np.concatenate([p, q])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(both) - inter)


def sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, set (sorted shingle hashes) of the classes in ``wanted`` (rep), each from the text of its smallest id; staged.

    The sets are known by their digests, so another text under the same id does no harm."""
    n = wanted.count()
    ids = classes.select("rep", F.col("doc").alias("doc_id")).join(broadcast_if_small(wanted, n), "rep", "left_semi").select("doc_id").distinct()
    texts = docs.select("doc_id", "text").join(broadcast_if_small(ids, n), "doc_id", "left_semi")

    def one(b: pa.RecordBatch) -> dict:
        sets = shingle_sets(b.column("text"))
        g1, g2 = digests(sets)
        return {"g1": g1, "g2": g2, "n_shingles": [len(s) for s in sets], "set": [s.tobytes() for s in sets]}

    rows = scan_with(texts, "g1 bigint, g2 bigint, n_shingles bigint, set binary", lambda: (one, None)).select(class_id().alias("rep"), "set")
    return stage(rows.join(broadcast_if_small(wanted, n), "rep", "left_semi").dropDuplicates(["rep"]), "sets", compression="none")


def confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int, m: int = M) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    sigs = classes.select("rep", "sig")
    same = least_same(percent, m)

    def alike(b: pa.RecordBatch) -> dict | None:
        x = np.frombuffer(b"".join(b.column("s1").to_pylist()), "<u4").reshape(-1, 4 * m)
        y = np.frombuffer(b"".join(b.column("s2").to_pylist()), "<u4").reshape(-1, 4 * m)
        ok = (x == y).sum(axis=1) >= same
        return {"a": b.column("a").to_numpy()[ok], "b": b.column("b").to_numpy()[ok]}

    with_sigs = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("s1")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("s2")), "b")
    near = stage(scan_with(with_sigs.select("a", "b", "s1", "s2"), "a bigint, b bigint", lambda: (alike, None)), "near")
    wanted = stage(near.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "wanted")
    # read twice below, once for each end of a pair
    sets = sets_of(docs, classes, wanted)

    def overlap(b: pa.RecordBatch) -> dict:
        ok = [alike_enough(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b.column("s1").to_pylist(), b.column("s2").to_pylist())]
        keep = np.array(ok, bool)
        return {"a": b.column("a").to_numpy()[keep], "b": b.column("b").to_numpy()[keep]}

    whole = near.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("s1")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("s2")), "b")
    out = stage(scan_with(whole.select("a", "b", "s1", "s2"), "a bigint, b bigint", lambda: (overlap, None)).distinct(), "links")
    for x in (near, wanted, sets):
        unstage(x)
    return out


def open_pairs(x: dict, same: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block pair's rows, most alike first: of two components, alike in ``same`` values, with a table in common,
    first met in this bucket."""
    sig, root, half, rep = np.frombuffer(b"".join(x["sig"]), "<u4").reshape(-1, 4 * m), x["root"], x["half"], x["rep"]
    t, crossed = int(x["t"][0]), x["i"][0] != x["j"][0]
    found = []
    left, right = (np.flatnonzero(half == 0), np.flatnonzero(half == 1)) if crossed else (np.arange(len(rep)),) * 2
    for k in range(0, len(left), 64):
        p = left[k : k + 64]
        # one value after another: small arrays stay in the cache
        count = np.zeros((len(p), len(right)), np.int8)
        for v in range(4 * m):
            count += sig[p, v][:, None] == sig[right, v][None, :]
        ok = (count >= same) & (root[p][:, None] != root[right][None, :])
        if not crossed:
            ok &= rep[p][:, None] < rep[right][None, :]
        a, b = np.nonzero(ok)
        if len(a):
            eq = sig[p[a]] == sig[right[b]]
            eq = eq[:, ::2] & eq[:, 1::2]
            first = eq[:, t] & (eq[:, :m].argmax(axis=1) == t) & eq[:, m:].any(axis=1)
            found.append(np.stack([count[a, b][first].astype(np.int64), p[a[first]], right[b[first]]]))
    n, a, b = np.concatenate([*found, np.zeros((3, 0), np.int64)], axis=1)
    order = np.argsort(-n, kind="stable")
    return a[order], b[order]


def in_groups(df: DataFrame, schema: str, one: Callable[[dict], dict | None]) -> DataFrame:
    """``one`` for the rows of each block pair (key, i, j), as a dict of columns."""
    by = ["key", "i", "j"]

    def make():
        kept: list[pa.Table] = []

        def whole(t: pa.Table) -> dict | None:
            cols = {c: t.column(c).to_pylist() if c in ("sig", "set") else t.column(c).to_numpy() for c in t.column_names}
            change = np.zeros(max(0, len(t) - 1), bool)
            for c in by:
                change |= cols[c][1:] != cols[c][:-1]
            at = [0, *(np.flatnonzero(change) + 1).tolist(), len(t)]
            out = [x for a, b in zip(at, at[1:]) if b - a > 1 and (x := one({c: v[a:b] for c, v in cols.items()}))]
            return {c: [y for x in out for y in x[c]] for c in out[0]} if out else None

        def batch(b: pa.RecordBatch) -> dict | None:
            t = pa.concat_tables([*kept, pa.Table.from_batches([b])])
            # the last group may go on in the next batch
            last = t.slice(len(t) - 1)
            same = np.ones(len(t), bool)
            for c in by:
                same &= t.column(c).to_numpy() == last.column(c)[0].as_py()
            n = int(same.argmax())
            kept[:] = [t.slice(n)]
            return whole(t.slice(0, n)) if n else None

        return batch, lambda: whole(kept[0]) if kept else None

    return scan_with(df.repartition(*by).sortWithinPartitions(*by), schema, make)


def block_count(n: F.Column, block: int = BLOCK) -> F.Column:
    """Into how many blocks a bucket of n rows is cut."""
    return F.ceil(n / F.least(F.greatest(F.ceil(n / BLOCKS), F.lit(block)), F.lit(max(block, MOST)))).cast("int")


def missing_links(docs: DataFrame, classes: DataFrame, roots: DataFrame, percent: int, m: int = M, block: int = BLOCK) -> DataFrame:
    """a < b: components (by their roots) that a pair of some large bucket still links; staged."""
    same = least_same(percent, m)
    rooted = stage(classes.select("rep", "sig").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "sig", F.coalesce("root", "rep").alias("root")), "rooted")
    # a class has one row for each hash of the first collection, m instead of m^2
    first = F.array(*[F.substring("sig", 8 * i + 1, 8) for i in range(m)])
    rows = rooted.select("rep", "root", "sig", F.posexplode(first).alias("t", "_a")).select(F.xxhash64("t", "_a").alias("key"), "t", "rep", "root", "sig")
    # buckets that are settled or covered by pairs go no further
    mixed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r1"), F.max("root").alias("r2"))
    mixed = stage(mixed.where((F.col("n") > FEW) & (F.col("r1") != F.col("r2"))).select("key", "n"), "mixed")
    k = mixed.count()
    if not k:
        for x in (rooted, mixed):
            unstage(x)
        return stage(docs.sparkSession.createDataFrame([], "a bigint, b bigint"), "links")
    rows = rows.join(broadcast_if_small(mixed, k), "key")
    # rows of block x meet each block y in the block pair (least, greatest)
    g = block_count(F.col("n"), block)
    rows = rows.withColumn("x", F.pmod(F.xxhash64("rep"), g).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), g - 1)))
    rows = rows.select("key", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") > F.col("y")).cast("int").alias("half"), F.col("t").cast("int").alias("t"), "rep", "root", "sig")
    kept = ("key", "i", "j", "half", "t", "rep", "root", "sig")

    def met(x: dict) -> dict | None:
        if (x["root"] == x["root"][0]).all():
            return None
        a, b = open_pairs(x, same, m)
        k = np.union1d(a, b)
        return {c: [x[c][i] for i in k] for c in kept} if len(k) else None

    def linked(x: dict) -> dict | None:
        up: dict[int, int] = {}

        def find(r: int) -> int:
            while r in up:
                r = up[r]
            return r

        sets = [np.frombuffer(s, np.uint64) for s in x["set"]]
        out = []
        for p, q in zip(*(v.tolist() for v in open_pairs(x, same, m))):
            r, s = find(int(x["root"][p])), find(int(x["root"][q]))
            if r != s and 100 * min(len(sets[p]), len(sets[q])) >= percent * max(len(sets[p]), len(sets[q])) and alike_enough(sets[p], sets[q], percent):
                up[max(r, s)] = min(r, s)
                out.append((min(r, s), max(r, s)))
        return {"a": [e[0] for e in out], "b": [e[1] for e in out]} if out else None

    schema = "key bigint, i int, j int, half int, t int, rep bigint, root bigint, sig binary"
    near = stage(in_groups(rows, schema, met), "open")
    wanted = stage(near.select("rep").distinct(), "wanted")
    sets = sets_of(docs, classes, wanted)
    out = stage(in_groups(near.join(sets, "rep").select(*kept, "set"), "a bigint, b bigint", linked).distinct(), "links")
    for x in (rooted, mixed, near, wanted, sets):
        unstage(x)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node of the edges (a < b)."""
    state = stage(edges.select(F.col("b").alias("u"), F.col("a").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        n, *rest = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, *rest) == seen or not n:
            break
        seen = (n, *rest)
        both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(broadcast_if_small(low, n), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(broadcast_if_small(low, n), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = stage(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        unstage(state)
        unstage(large)
        state = after
    out = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._leafmill_path = state._leafmill_path
    return out


def near_groups(docs: DataFrame, percent: int = 85, m: int = M, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash of each row.

    Rows without words, and rows of a null doc_id, link to nothing. Equal sets always link. Rows that repeat a doc_id
    and text give equal rows; rows of one doc_id and different texts are judged each by its text. An empty table gives
    none. Other columns are ignored.
    """
    signed = stage(signatures(docs, m), "signatures")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("g1", "g2", "n_shingles").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    classes = stage(classes.withColumn("rep", class_id()), "classes")
    pairs = candidates(classes, m, hot)
    links = confirmed(docs, classes, pairs, percent, m)
    unstage(pairs)
    roots = components(links)
    more = missing_links(docs, classes, roots, percent, m)
    again = components(more)
    joined = again.select(F.col("node").alias("was"), F.col("root").alias("now"))
    for x in (links, more):
        unstage(x)
    # classes of components of several
    known = roots.select("node", F.col("root").alias("was"))
    ends = roots.select(F.col("root").alias("node")).unionByName(joined.select(F.explode(F.array("was", "now")).alias("node"))).distinct()
    known = known.unionByName(ends.join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("was")))
    known = known.join(joined, "was", "left").select(F.col("node").alias("rep"), F.coalesce("now", "was").alias("root"))
    of_all = stage(known.join(classes.select("rep", "doc"), "rep").select("rep", "root", "doc"), "rooted")
    least = of_all.groupBy("root").agg(F.min("doc").alias("low"))
    of = of_all.join(broadcast_if_small(least, of_all.count()), "root").select("rep", "low")
    grouped = classes.join(of, "rep", "left").where("copies > 1 or low is not null").select("g1", "g2", "n_shingles", F.coalesce("low", "doc").alias("component"))
    grouped = stage(grouped, "groups")
    for x in (classes, roots, again, of_all):
        unstage(x)
    out = signed.drop("sig").join(broadcast_if_small(grouped, grouped.count()), ["g1", "g2", "n_shingles"], "left")
    comp = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"), "text_hash")
