"""Operators against small cases and plain Python models."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions import similarity, text
from leafmill.operators import cards, chunking, deck, dedup, identity, profile, registry, retrieval, structure, telemetry, validate


def rows(df):
    return [tuple(r) for r in df.collect()]


def pages_of(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts, 1)], "doc_id bigint, page_num int, raw_text string")


def test_blank_pages_give_no_chunks(spark):
    p = pages_of(spark, "", "   ", "\n\n", None)
    assert chunking.by_pages(p).count() == 0 and chunking.by_paragraphs(p).count() == 0 and chunking.full_text(p).count() == 0


def test_short_pages_are_numbered_through(spark):
    c = chunking.by_pages(pages_of(spark, *["word " * 30] * 4), 50).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in c] == list(range(len(c))) and {r["total_chunks"] for r in c} == {len(c)} and all(r["start_page"] <= r["end_page"] for r in c)


def test_oversize_page_is_split(spark):
    c = chunking.by_pages(pages_of(spark, "This is a sentence with some words. " * 50), 50).collect()
    assert len(c) > 1 and all(r["token_count"] <= 50 for r in c)


def model_split(paras, target):
    """Greedy packing with up to two paragraphs carried over, on texts."""
    out, cur, held = [], "", []
    for p in paras:
        pot = f"{cur}\n\n{p}" if cur else p
        if len(pot) // 4 > target and cur:
            out.append(cur)
            over = held[-2:]
            nxt = "\n\n".join([*over, p])
            cur, held = (p, [p]) if len(nxt) // 4 > target else (nxt, [*over, p])
        else:
            cur, held = pot, [*held, p]
    return [*out, cur] if cur else out


def test_runs_equal_a_sequential_model(spark):
    r = random.Random(3)
    cases = [[("x" * r.randint(1, 90)) for _ in range(r.randint(0, 12))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(cases)), "k int, u array<string>")
    got = {k: t for k, t in df.select("k", chunking.packed_texts(F.col("u"), 25, carry=2).alias("t")).collect()}
    assert got == {k: model_split(u, 25) for k, u in enumerate(cases)}


def test_entire_modes(spark):
    p = pages_of(spark, "Intro text here.\n\nMore.", "Body of it.")
    whole = chunking.chunk("entire", p).collect()
    assert len(whole) == 1 and whole[0]["section"] == "Entire Document" and whole[0]["end_page"] == 2
    parts = chunking.chunk("entire", pages_of(spark, *["paragraph of words " * 20] * 6), token_budget=150).collect()
    assert len(parts) > 1 and all(r["section"].startswith("Document Part") for r in parts)


def test_trimming(spark):
    d = spark.createDataFrame([("Main.\nConclusion\nDone.\nReferences\n1. x\nAppendix\ny",), ("No heading at all",)], "t string")
    assert rows(d.select(chunking.trim_terminal(F.col("t")))) == [("Main.\nConclusion\nDone.",), ("No heading at all",)]


def test_smart_overlap_and_headings(spark):
    p = pages_of(spark, *[f"page {i} " + "w " * 60 for i in range(4)])
    h = spark.createDataFrame([(1, 0, "Head", 3, 1)], "doc_id bigint, ord int, text string, page int, level int")
    s = spark.createDataFrame([], "doc_id bigint, sec_no int, title string, start_page int, end_page int")
    c = chunking.smart(p, h, s, budget=50, overlap=8).orderBy("chunk_index").collect()
    assert any(r["section"] == "Head" for r in c) and len(c) == 4
    with pytest.raises(ValueError):
        chunking.chunk("other", p)


def test_headings_borders(spark):
    at = lambda t, size=15.0, flags=0, n=0: (1, 1, 0, n, 0, t, size, flags)
    d = spark.createDataFrame([at("Big", n=0), at("Not big", 14.0, n=1), at("Bold", 10.0, 16, n=2), at("Ends.", n=3), at("x" * 199, n=4), at("x" * 200, n=5), at("w " * 19, n=6), at("w " * 20, n=7)],
                              "doc_id bigint, page_num int, block_no int, line_no int, span_no int, text string, size double, flags int")
    got = {r["text"]: r["level"] for r in structure.headings(d).collect()}
    assert set(got) == {"Big", "Bold", "x" * 199, ("w " * 19).strip()} and got["Big"] == 3


def test_blocks(spark):
    d = spark.createDataFrame([(1, 1, 0, 0, None, None, [["a", "b"], [" "]]), (1, 1, 1, 0, None, None, [[""]]), (1, 1, 2, 1, 5, 6, None), (1, 1, 3, 7, None, None, None)], "doc_id int, page_num int, block_no int, type int, width int, height int, lines array<array<string>>")
    assert [(r["type"], r["lines"]) for r in structure.blocks_to_lines(d).orderBy("block_no").collect()] == [("text", ["ab"]), ("image", None)]


def test_profile(spark):
    mk = lambda i, n, first, last: [(i, k, first if k == 1 else last if k == n else "x") for k in range(1, n + 1)]
    d = spark.createDataFrame(mk(1, 12, "Abstract\ndoi: 10.1234/abc", "References\n1.") + mk(2, 150, "Chapter 1\nintro", "end") + mk(3, 5, "plain", "plain"), "doc_id bigint, page_num int, raw_text string")
    f = profile.features(d, spark.createDataFrame([(2,)], "doc_id bigint"))
    assert dict(rows(f.select("doc_id", "doc_type"))) == {1: "research_paper", 2: "textbook", 3: "unknown"}
    got = {r["doc_id"]: (r["mode"], r["tokens_per_chunk"]) for r in profile.defaults(f).collect()}
    assert got == {1: ("sections", 1500), 2: ("smart", 3000), 3: ("pages", 2000)}


def test_parse_responses(spark):
    d = spark.createDataFrame([
        (1, 0, 4, "key_points", '{"cards": [{"front": " a ", "back": "b", "tags": ["X", "x"]}]}'), (2, 0, 1, "key_points", '{"cards": [{"front": 5, "back": "b"}]}'), (3, 0, 1, "key_points", "[]"),
        (4, 0, 1, "key_points", "oops"), (5, 0, 1, "key_points", '{"none": 1}'), (6, 0, 1, "cloze_definitions", '{"cards": [{"cloze_text": "no mark"}]}'), (7, 0, 1, "cloze_definitions", '{"cards": [{"cloze_text": "{{c1::x}}", "tags": "A; b"}]}'),
    ], "doc_id bigint, chunk_index int, start_page int, strategy string, content string")
    got = {r["doc_id"]: r for r in cards.parse_responses(d).collect()}
    assert set(got) == {1, 7} and got[1]["front"] == "a" and got[1]["tags"] == ["key-points", "x"] and got[1]["page_citation"] == "p. 4" and got[7]["tags"] == ["cloze-definitions", "a", "b"] and got[7]["difficulty"] == "medium"


def test_quotes_of_ten_and_eleven(spark):
    c = spark.createDataFrame([(1, 0, 'says "1234567890"', "", "", "", "p. 1", "p. 1"), (2, 0, 'says "12345678901"', "", "", "", "p. 1", "p. 1"), (3, 0, 'says "IN THE TEXT!"', "", "", "", "p. 1", "p. 1"), (4, 0, "x", "", "", "", "", "p. 1")], "doc_id int, chunk_index int, front string, back string, cloze_text string, extra string, page_citation string, ref_citation string")
    k = spark.createDataFrame([(i, 0, "words in the text! more") for i in range(1, 5)], "doc_id int, chunk_index int, text string")
    assert {r["doc_id"] for r in cards.verified(c, k).collect()} == {1, 3}
    assert cards.verified(c, k, drop=False).count() == 4


def test_review(spark):
    c = spark.createDataFrame([(1, "Basic", "f", "b", ""), (2, "Basic", "f", "b", ""), (3, "Cloze", "", "", "{{c1::x}}"), (4, "Basic", "f", "b", "")], "card_ord int, note_type string, front string, back string, cloze_text string")
    r = spark.createDataFrame([(1, 8.5, ["i"], "new", None), (2, 6.5, [], None, None), (3, 9.0, [], "{{c1::y}}", None)], "card_ord int, score double, issues array<string>, edit_front string, edit_back string")
    got = {x["card_ord"]: x for x in cards.reviewed(c, r).collect()}
    assert set(got) == {1, 3, 4} and got[1]["front"] == "new" and got[1]["review_edited"] and got[3]["cloze_text"] == "{{c1::y}}" and not got[4]["review_edited"]
    assert cards.reviewed(c, r, 6.0).count() == 4
    assert not any(x["review_edited"] for x in cards.reviewed(c, r, allow_edits=False).collect())


CARD = "card_ord bigint, note_type string, front string, back string, cloze_text string, extra string, source_pdf string, page_start int, page_end int, section string, strategy string, core_concept string"


def card(i, front="f", back="b", kind="Basic", cloze="", concept="c"):
    return (i, kind, front, back, cloze, "", "a.pdf", 1, 2, None, "key_points", concept)


def test_ids(spark):
    d = spark.createDataFrame([card(1), card(2, "F"), card(3, "g"), card(4, "é")], CARD)
    a, b = (dict(rows(identity.content_ids(d, s).select("card_ord", "id"))) for s in ("s", "t"))
    assert a[1] == a[2] != a[3] and a[1] != b[1] and len(a[1]) == 32
    assert a[4] == hashlib.blake2b("s|Basic|é||b|a.pdf|1-2".encode(), digest_size=16).hexdigest()


def test_persistent_ids(spark):
    d = spark.createDataFrame([card(1), card(2, "other front"), card(3, concept="d")], CARD)
    none = spark.createDataFrame([], "key string, id string")
    first = identity.persistent_ids(d, none, "s")
    assert dict(rows(first.select("card_ord", "id"))) == {1: "s_000001", 2: "s_000001", 3: "s_000002"}
    again = identity.persistent_ids(spark.createDataFrame([card(5), card(6, concept="new")], CARD), identity.known_ids(first), "s")
    assert dict(rows(again.select("card_ord", "id"))) == {5: "s_000001", 6: "s_000003"}


def test_indel_against_tables():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = row[:]
            for j, y in enumerate(b):
                row[j + 1] = prev[j] + 1 if x == y else max(prev[j + 1], row[j])
        return row[-1]

    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abcé") for _ in range(r.randint(0, 20))) for _ in range(2))
        assert similarity.common_subsequence(a, b) == lcs(a, b)
    assert similarity.indel_ratio("", "") == 1.0 and similarity.indel_ratio("kitten", "sitting") == pytest.approx(8 / 13)


def test_greedy_first_is_sequential(spark):
    r = random.Random(5)
    n = 60
    edges = [(i, j) for i in range(n) for j in range(i + 1, n) if r.random() < 0.06]
    kept = []
    for j in range(n):
        if not any((i, j) in set(edges) for i in kept):
            kept.append(j)
    got = dedup.greedy_first(spark.range(n).select(F.col("id").alias("card_ord")), spark.createDataFrame(edges, "i bigint, j bigint"))
    assert sorted(x for (x,) in rows(got)) == kept


def test_within_run_is_sequential(spark):
    r = random.Random(9)
    base = ["".join(r.choice("abcdef ") for _ in range(40)) for _ in range(6)]
    texts = ["".join(c if r.random() > 0.08 else r.choice("xyz") for c in r.choice(base)) for _ in range(40)]
    d = spark.createDataFrame([card(i, t, "") for i, t in enumerate(texts)], CARD)
    kept = []
    for i, t in enumerate(texts):
        if not any(similarity.indel_ratio(t + " | ", texts[k] + " | ") >= 0.85 for k in kept):
            kept.append(i)
    assert sorted(x["card_ord"] for x in dedup.within_run(d).collect()) == kept


def test_exact_dedup(spark):
    d = spark.createDataFrame([card(1, "Python"), card(2, " python "), card(3, "Java")], CARD)
    assert {x["card_ord"] for x in dedup.by_front(d).collect()} == {1, 3}
    left, index = dedup.against_index(d, spark.createDataFrame([], "content_hash string"))
    assert left.count() == 3 and index.count() == 2
    assert dedup.against_index(d, index)[0].count() == 0


def test_top_k_with_blocks(spark):
    r = random.Random(2)
    v = [(i, [r.random() - 0.5 for _ in range(8)]) for i in range(40)] + [(99, [0.0] * 8)]
    e = spark.createDataFrame(v, "vec_id bigint, embedding array<float>")
    q = e.where("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    got = {}
    for x in retrieval.top_k(q, e, 3, block=3).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    import numpy as np

    m = np.array([x for _, x in v], dtype=np.float32).astype(float)
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    assert got == {i: [v[k][0] for k in np.argsort(-np.round(m @ m[i], 9), kind="stable")[:3]] for i in range(7)}


def test_validation_and_deck(spark):
    d = spark.createDataFrame([("1", "Odd", "x"), (None, None, "")], "id string, note_type string, front string")
    got = {(x["rule"], x["field"]) for x in validate.issues(d).collect()}
    assert ("missing_column", "deck") in got and ("empty_id", "id") in got and ("id_length", "id") in got and ("missing_note_type", "note_type") in got
    assert validate.note_type_ok({"fields": [1], "templates": [1]}) and not validate.note_type_ok({"fields": []})
    tags = spark.createDataFrame([(["A b"] * 3 + [f"t{i}" for i in range(30)], "s", "Basic")], "tags array<string>, strategy string, note_type string")
    assert len(tags.select(deck.deck_tags().alias("t")).first()["t"]) == 20


def test_telemetry(spark):
    c = spark.createDataFrame([("a", 10, 1.0, True, 2), ("b", 5, 0.5, False, 1)], "strategy string, tokens bigint, cost double, cached boolean, cards bigint")
    m = telemetry.manifest(c, model="m")
    assert m["totals"]["tokens"] == 15 and m["by_strategy"]["a"]["cards"] == 2 and m["cache_hit_rate"] == 0.5


def test_registry_keeps_overrides(spark):
    old = spark.createDataFrame([("a", False, "x", 1, "d1", "smart")], "key string, enabled boolean, doc_type string, page_count int, last_scanned string, override_mode string")
    new = spark.createDataFrame([("a", "y", 2, "d2"), ("b", "z", 3, "d2")], "key string, doc_type string, page_count int, last_scanned string")
    got = {r["key"]: r for r in registry.upserted(old, new).collect()}
    assert got["a"]["override_mode"] == "smart" and got["a"]["doc_type"] == "y" and not got["a"]["enabled"] and got["b"]["enabled"]


def test_text_functions(spark):
    d = spark.createDataFrame([("  a 　\u001c",), ("",), (None,)], "x string")
    assert rows(d.select(text.strip(F.col("x")))) == [("a",), ("",), (None,)]
    assert rows(spark.createDataFrame([("abcdefghij",)], "x string").select(text.truncate_tokens(F.col("x"), 2), text.truncate_tokens(F.col("x"), 2, "start"), text.truncate_tokens(F.col("x"), 2, "middle"))) == [("abcdefgh...[truncated]", "[truncated]...cdefghij", "abcd...[middle truncated]...ghij")]


def test_figure_words(spark):
    chunks = spark.createDataFrame([(1, "see Fig. 2"), (2, "a picture of it"), (3, "exhibit A"), (4, "as depicted, shown in a visualization"), (5, "Table 1"), (6, "diagram")], "doc_id bigint, text string").withColumns({"start_page": F.lit(1), "end_page": F.lit(2)})
    images = spark.createDataFrame([(i, 2) for i in range(1, 6)], "doc_id bigint, page_num int")
    assert {r["doc_id"] for r in cards.figure_chunks(chunks, images).collect()} == {1, 2, 3, 5}
    assert {r["doc_id"] for r in cards.figure_chunks(chunks, images.limit(0)).collect()} == {5}


def test_an_overlong_first_paragraph(spark):
    d = spark.createDataFrame([(1, "x" * 5492 + "\n\n" + "y" * 20, 1)], "doc_id bigint, text string, page_count int")
    assert [(len(r["text"]), r["section"]) for r in chunking.entire(d, 900, 2000).orderBy("chunk_index").collect()] == [(5492, "Document Part 1"), (5514, "Document Part 2")]


def test_saved_columns_and_completeness(spark):
    from leafmill.operators import validate
    from leafmill.sources import files, sinks

    c = spark.createDataFrame([("a", "k")], "id string, core_concept string")
    assert "core_concept" in files.CARD_COLUMNS and "subsection" not in files.CARD_COLUMNS and len(files.CARD_COLUMNS) == 24
    assert sinks.card_columns(c).first()["core_concept"] == "k" and [r["field"] for r in validate.completeness(c).collect()] == ["core_concept"]


def test_alike_vectors_in_blocks(spark):
    from leafmill.operators import retrieval

    r = random.Random(1)
    v = [(i, [r.choice([-1.0, 0.0, 1.0]) for _ in range(6)]) for i in range(90)]
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<double>")
    n = lambda x: sum(a * a for a in x) ** 0.5
    want = {(i, j) for i, a in v for j, b in v if i < j and n(a) and n(b) and round(sum(x * y for x, y in zip(a, b)) / n(a) / n(b), 6) >= 0.8}
    assert {(x["i"], x["j"]) for x in retrieval.similar_pairs(df, 0.8, block=17).collect()} == want


def test_search_in_cells_is_exact_and_leaves_cells_out(spark):
    import numpy as np

    from leafmill.operators import retrieval

    r = np.random.default_rng(4)
    middle = r.normal(size=(12, 16))
    v = np.concatenate([middle[np.arange(600) % 12] + 0.05 * r.normal(size=(600, 16)), np.repeat(middle[:1], 150, axis=0), np.zeros((3, 16)), r.normal(size=(40, 16))])
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.where(n > 0, v / np.maximum(n, 1e-300), 0.0)
    s = np.round(u @ u.T, 9)
    asked = [*range(0, 793, 37), 750, 751]
    q = df.where(F.col("vec_id").isin(asked)).withColumnRenamed("vec_id", "query_id")
    index = retrieval.CellIndex(df, pivots=24, block=50)
    got = {}
    for x in retrieval.top_k(q, index, 4, block=50).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], round(x["score"], 6)))
    assert got == {i: [(int(k), round(float(s[i, k]), 6)) for k in np.lexsort((np.arange(len(v)), -s[i]))[:4]] for i in asked}
    read = {x["query_id"]: x["cells"] / x["of"] for x in retrieval.cells_read(q, index, 4, block=50).collect()}
    assert np.median(list(read.values())) < 0.5 and read[750] == 1.0  # a zero vector has no direction to prune by
    t = np.round(u @ u.T, 6)
    for least in (0.9, 0.3, -0.2):
        want = {(int(i), int(j)) for i, j in zip(*np.nonzero(t >= least)) if i < j}
        assert {(x["i"], x["j"]) for x in retrieval.similar_pairs(df, least, block=64).collect()} == want
    assert retrieval.top_k(q.limit(0), df, 2).count() == 0 and retrieval.top_k(q, df.limit(0), 2).count() == 0 and retrieval.similar_pairs(df.limit(0), 0.5).count() == 0


def near_copies_of(r, words, n, sizes):
    out = []
    for _ in range(n):
        x = " ".join(r.choice(words) for _ in range(r.choice(sizes)))
        out.append(x)
        for _ in range(r.randint(0, 3)):
            y = list(x)
            for _ in range(r.randint(0, max(1, len(y) // 12))):
                k = r.randrange(len(y) + 1)
                y[k : k + r.randint(0, 1)] = r.choice("abcé ")
            out.append("".join(y))
    return out


@pytest.mark.parametrize("least", [0.85, 0.6, 0.99, 1.0])
def test_near_texts_equal_brute_force(spark, least):
    r = random.Random(8)
    texts = sorted({"", "a", "b", "ab", *near_copies_of(r, ["alpha", "beta", "gamma", "été", "x"], 25, [1, 2, 5, 20, 60])})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None)], "card_ord long, text string").withColumn("card_ord", F.col("card_ord").cast("decimal(38,0)"))
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and similarity.indel_ratio(a, b) >= least}
    # small blocks, so that bands are cut into many
    got = [(int(x["i"]), int(x["j"])) for x in dedup.near_texts(df, least, block_chars=900).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_blocks_of_single_texts_hold_the_same_pairs(spark, monkeypatch):
    r = random.Random(5)
    texts = sorted({"", *near_copies_of(r, ["alpha", "beta", "été"], 8, [2, 30])})
    df = spark.createDataFrame(list(enumerate(texts)), "card_ord long, text string")
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and similarity.indel_ratio(a, b) >= 0.85}
    monkeypatch.setattr(dedup, "BLOCK_MICROSECONDS", 1)  # no two texts are compared within it
    got = [tuple(x) for x in dedup.near_texts(df).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want
    assert dedup.near_texts(df.limit(0)).count() == 0


def test_near_pairs_by_text_and_vector(spark):
    rows = [(0, "the same words here", [1.0, 0.0]), (1, "the same words her", [0.0, 1.0]), (2, "quite another text", [1.0, 0.01]), (3, "the same words here!", [1.0, 0.0]), (4, "no vector", None)]
    df = spark.createDataFrame(rows, "card_ord bigint, text string, embedding array<double>")
    pairs = lambda *a: {tuple(x) for x in dedup.near_pairs(df, *a).collect()}
    assert pairs(0.85) == {(0, 1), (0, 3), (1, 3)}
    assert pairs(0.85, 0.9, "OR") == {(0, 1), (0, 3), (1, 3), (0, 2), (2, 3)}
    assert pairs(0.85, 0.9, "AND") == {(0, 3)}
    assert pairs(0.0, 0.9) == {(0, 2), (0, 3), (2, 3)} and pairs(0.0) == set()


def test_given_up_comparisons_are_the_ratio():
    r = random.Random(3)
    texts = ["", "a", "é" * 5] + ["".join(r.choice("abcdeé ") for _ in range(r.randint(1, 300))) for _ in range(80)]
    for a, b in zip(texts, reversed(texts)):
        for other in (b, a[: len(a) // 2] + a[len(a) // 2 + 3 :]):
            for least in (0.5, 0.85):
                assert similarity.reaches(a, other, least) == (similarity.indel_ratio(a, other) >= least)
                assert similarity.reaches(a, other, least, similarity.places(a)) == (similarity.indel_ratio(a, other) >= least)


def test_unrelated_texts_are_given_up_early():
    import random

    from leafmill.functions import similarity

    class Asked(dict):
        n = 0

        def get(self, *k):
            Asked.n += 1
            return super().get(*k)

    some = random.Random(7)
    text = lambda n: "".join(some.choice("etaoinshrdlu ") for _ in range(n))
    for n in (200, 2000):
        a, b = text(n), text(n)
        Asked.n = 0
        assert not similarity.reaches(a, b, 0.85, Asked(similarity.places(a)))
        assert Asked.n < 0.36 * n


@pytest.mark.parametrize("letters", ["ab", "etaoinshrdlu ", "aé漢\U0001f600 \n"])
@pytest.mark.parametrize("least", [0.5, 0.85])
def test_blocks_give_the_pairs_of_a_comparison_one_by_one(letters, least):
    import random

    import pandas as pd

    from leafmill.functions import similarity

    some = random.Random(11)
    texts = {"": None}
    for n in (1, 62, 63, 64, 126, 127, 200, 300) * 2:
        t = "".join(some.choice(letters) for _ in range(n))
        for share in (0, 0.1, 0.2, 0.35):
            texts["".join(some.choice(letters) + c if r < share / 2 else "" if r < share else c for c in t for r in [some.random()])] = None
    texts = list(texts)
    want = {(i, j) for j in range(len(texts)) for i in range(j) if similarity.indel_ratio(texts[i], texts[j]) >= least}
    side = lambda y, ids: pd.DataFrame({"a": 0, "x": 0, "b": 0, "y": y, "id": ids, "text": [texts[i] for i in ids]})
    for alone in (1, 10**9):  # all pairs at a time, or one after another
        similarity.PAIRS_A_WORD, before = alone, similarity.PAIRS_A_WORD
        try:
            whole = similarity.block_pairs(least)(side(0, range(len(texts))), side(0, range(len(texts))))
            parts = similarity.block_pairs(least)(side(1, range(0, len(texts), 2)), side(1, range(1, len(texts), 2)))
        finally:
            similarity.PAIRS_A_WORD = before
        assert set(map(tuple, whole.values.tolist())) == want and len(whole) == len(want)
        assert set(map(tuple, parts.values.tolist())) == {p for p in want if (p[0] + p[1]) % 2}


def test_texts_of_one_length_go_to_few_tasks(spark, monkeypatch):
    texts = [f"text {i:04}" for i in range(200)]  # one band
    df = spark.createDataFrame(list(enumerate(texts)), "card_ord long, text string")

    def sizes(least):
        import pandas as pd

        return lambda a, b: pd.DataFrame({"i": [len(a)], "j": [len(b)]})

    monkeypatch.setattr(dedup, "block_pairs", sizes)
    monkeypatch.setattr(dedup, "BLOCK_MICROSECONDS", 1)  # however long the comparisons are meant to take
    sent = sum(x["i"] + x["j"] for x in dedup.near_texts(df).collect())
    most = max(2, round(0.75 * spark.sparkContext.defaultParallelism**0.5))
    assert len(texts) <= sent <= most * len(texts)  # 13,600 before


@pytest.mark.parametrize("letters", ["etaoinshrdlucmfwypvbgkjqxz .,", "ab", "".join(map(chr, range(0x4E00, 0x4E00 + 300)))])
def test_characters_apart_lose_no_pair(letters):
    import zlib

    import numpy as np
    import pandas as pd

    some = random.Random(4)
    often = [1 / (k + 2) for k in range(len(letters))]
    draw = lambda n: some.choices(letters, often, k=n)
    texts = {}
    for n in (900, 1100, 1300) * 6:
        t = draw(n)
        for share in (0, 0.07, 0.145, 0.155, 0.25):  # some just reach 0.85, others just fail
            texts["".join(draw(1)[0] if some.random() < share else c for c in t)] = None
    texts = list(texts)
    want = {(i, j) for j in range(len(texts)) for i in range(j) if similarity.indel_ratio(texts[i], texts[j]) >= 0.85}
    packed = [zlib.compress(t.encode()) for t in texts]
    side = lambda y, ids: pd.DataFrame({"a": 0, "x": 0, "b": 0, "y": y, "id": ids, "text": [packed[i] for i in ids]})
    alone = similarity.block_pairs(0.85)(side(0, range(len(texts))), side(0, range(0)))
    assert want and sorted(map(tuple, alone.values.tolist())) == sorted(want)
    both = similarity.block_pairs(0.85)(side(1, range(0, len(texts), 2)), side(1, range(1, len(texts), 2)))
    assert sorted(map(tuple, both.values.tolist())) == sorted(p for p in want if (p[0] + p[1]) % 2)
    assert np.issubdtype(alone["i"].dtype, np.integer)


def test_texts_that_meet_tiles_lose_no_pair_and_few_are_left_to_be_paired(monkeypatch):
    """Of texts that only have their characters' shares in common, a tile at once turns most away; what reaches 0.85 stays."""
    import pandas as pd

    some = random.Random(6)
    letters, often = "etaoinshrdlucmfwypvbgk .,", [1 / (k + 2) for k in range(25)]
    draw = lambda n: some.choices(letters, often, k=n)
    texts = {}
    for k in range(50):
        t = draw(some.randint(600, 700))
        for share in (0, 0.145, 0.155):
            texts["".join(draw(1)[0] if some.random() < share else c for c in t)] = None
    texts = list(texts)
    want = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if similarity.indel_ratio(texts[i], texts[j]) >= 0.85]
    paired, by_ranks = [], similarity._by_ranks
    monkeypatch.setattr(similarity, "_by_ranks", lambda a, b, x, *of: paired.append(len(x)) or by_ranks(a, b, x, *of))
    side = lambda y, ids: pd.DataFrame({"a": 0, "x": 0, "b": 0, "y": y, "id": ids, "text": [texts[i] for i in ids]})
    alone = similarity.block_pairs(0.85)(side(0, range(len(texts))), side(0, range(0)))
    assert want and sorted(map(tuple, alone.values.tolist())) == want
    assert max(paired) < 0.3 * len(texts) * (len(texts) - 1) / 2
    both = similarity.block_pairs(0.85)(side(1, range(0, len(texts), 2)), side(1, range(1, len(texts), 2)))
    assert sorted(map(tuple, both.values.tolist())) == [p for p in want if (p[0] + p[1]) % 2]
