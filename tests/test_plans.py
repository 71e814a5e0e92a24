"""Settings, templates, sources and sinks, the whole chain, incremental runs."""

import hashlib
import json
import warnings

import pytest
from pyspark.sql import functions as F

from leafmill.operators import cards, chunking, deck, generation, retrieval, telemetry
from leafmill.plans import build, templates
from leafmill.plans import cards as plan
from leafmill.plans.config import Config, Llm
from leafmill.sources import content, files, registry_file, sinks
from leafmill.streaming import incremental


def test_config_round_trip(tmp_path, monkeypatch):
    monkeypatch.setenv("SOME_KEY", "s3")
    tree = {"pipeline": {"ingestion": {"chunking": {"mode": "pages", "tokens_per_chunk": 9}}, "llm": {"api_key": "${SOME_KEY}"}}, "generate": {"strategies": {"figure_based": {"enabled": False, "params": {"n": 1}}}}}
    c = Config.from_dict(tree)
    assert c.pipeline.llm.api_key == "s3" and c.generate.strategies.enabled() == ["key_points", "cloze_definitions"] and c.pipeline.ingestion.chunking.tokens_per_chunk == 9
    c.to_yaml(str(tmp_path / "c.yaml"))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert Config.from_yaml(str(tmp_path / "c.yaml")) == c
    with pytest.warns(DeprecationWarning):
        old = Config.from_dict({"inputs": {"recursive": False}, "ingestion": {"chunking": {"mode": "entire"}}, "llm": {"model": "gpt-4"}, "ids": {"salt": "x"}, "language": "fr", "deduplication": {"policy": "and"}})
    assert (old.pipeline.ingestion.chunking.mode, old.pipeline.llm.model, old.generate.ids.salt, old.generate.language, old.pipeline.deduplication.policy, old.inputs.recursive) == ("entire", "gpt-4", "x", "fr", "and", False)
    with pytest.warns(UserWarning, match="pipeline.llm.wrong"):
        Config.from_dict({"pipeline": {"llm": {"wrong": 1}}})
    with pytest.raises(ValueError):
        Config.from_dict({"pipeline": {"ingestion": {"chunking": {"mode": "none"}}}})
    (tmp_path / "empty.yaml").write_text("")
    assert Config.from_yaml(str(tmp_path / "empty.yaml")) == Config()


def test_templates(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("name: p\nversion: '1.0'\ntemplate: old\n")
    (tmp_path / "b.yaml").write_text("name: p\nversion: '2.0'\nsafety_rule: be safe\nmax_chunk_tokens: 2\nparameters: {max_cards: {type: int, default: 5}}\ntemplate: 'Make {{ max_cards }} of {{chunk_text}} like {{c1::x}}. {{ safety_rule }}'\n")
    (tmp_path / "c.yaml").write_text("name: [bad\n")
    p = templates.prompts(str(tmp_path))["p"]
    d = spark.createDataFrame([("abcdefghij",)], "t string")
    assert d.select(templates.render(p, chunk_text=F.col("t"))).first()[0] == "Make 5 of abcdefgh...[truncated] like {{c1::x}}. be safe"
    with pytest.raises(KeyError):
        templates.render(p)
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/basic.yaml").write_text("name: basic\nfields: [{name: front}, {name: back}]\n")
    got = templates.note_types(str(tmp_path / "notes"))["basic"].csv_fields()
    assert got[:2] == ["front", "back"] and len(got) == 22


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, t in (("b.pdf", "p1\fp2\fp3"), ("a.pdf", "q1"), ("bad.pdf", "!"), ("x.txt", "no")):
        (tmp_path / "in" / n).write_text(t)
    assert [r["path"].rsplit("/", 1)[1] for r in files.discover(spark, [str(tmp_path / "in")]).collect()] == ["a.pdf", "b.pdf", "bad.pdf"]

    def extractor(path, content):
        if content == b"!":
            raise ValueError("unreadable")
        return content.decode().split("\f")

    got = [(r["path"].rsplit("/", 1)[1], r["page_num"], r["raw_text"]) for r in files.extract(spark, [str(tmp_path / "in")], extractor, last=2).orderBy("path", "page_num").collect()]
    assert got == [("a.pdf", 1, "q1"), ("b.pdf", 1, "p1"), ("b.pdf", 2, "p2")]
    assert files.metadata(files.discover(spark, [str(tmp_path / "in")])).first()["title"] == "a"
    sha = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in files.with_digest(spark, [str(tmp_path / "in")]).collect()}
    assert sha["x.txt"] == hashlib.sha256(b"no").hexdigest()
    assert files.dedup_index(spark, str(tmp_path / "none")).count() == 0


def test_whole_chain_and_files(spark, tmp_path):
    pages = spark.createDataFrame([(d, p, "\n\n".join(f"doc {d} page {p} line {i} has words of its own {hashlib.md5(f'{d}{p}{i}'.encode()).hexdigest()}" for i in range(3))) for d in (1, 2) for p in (1, 2)], "doc_id bigint, page_num int, raw_text string")
    out = plan.build(pages, Config.from_dict({"pipeline": {"ingestion": {"chunking": {"mode": "pages", "tokens_per_chunk": 100}}, "deduplication": {"fuzzy_threshold": 0.97}}, "generate": {"strategies": {"figure_based": {"enabled": False}}}}), now=F.lit("now"), ask=cards.mock_responses).persist()
    assert out.count() > 4 and out.select("id").distinct().count() == out.count() and set(r["note_type"] for r in out.collect()) == {"Basic", "Cloze"}
    sinks.save_cards(out, str(tmp_path / "csv"), single=True)
    back = files.cards_csv(spark, str(tmp_path / "csv"))
    assert back.count() == out.count() and set(files.CARD_COLUMNS) <= set(back.columns) and isinstance(back.first()["tags"], list)
    sinks.save_package(deck.notes(out, "D"), deck.decks(out, "D"), str(tmp_path / "deck"))
    assert spark.read.parquet(str(tmp_path / "deck/notes")).count() == out.count()
    with pytest.raises(ValueError):
        sinks.save_package(deck.notes(out.where("false"), "D"), deck.decks(out, "D"), str(tmp_path / "none"))
    sinks.save_manifest({"a": 1}, str(tmp_path / "m.json"))
    assert sinks.load_manifest(str(tmp_path / "m.json"))["a"] == 1 and sinks.load_manifest(str(tmp_path / "gone")) == {}
    assert sinks.sample_schema({"b": ["x"], "a": ["y"]})[0] == {"note_type": "a", "x": "", "y": "Example y"}


def test_incremental(spark, tmp_path):
    schema = "card_ord bigint, note_type string, front string, back string, cloze_text string, extra string"
    put = lambda rows: spark.createDataFrame([(i, "Basic", f, "b", "", "") for i, f in rows], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: incremental.new_cards(incremental.read_cards(spark, str(tmp_path / "in"), schema), str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "cp"))
    put([(1, "x"), (2, "X "), (3, "y")])
    run()
    put([(4, "x"), (5, "z")])
    run()
    # of equal cards in one batch the first by card_ord stays
    assert sorted(r["card_ord"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3, 5]


def test_thirty_five_cards_keep_their_order(spark):
    rows = [(d, c, s, n) for d in (-5, 3, 2**62) for c in (0, 7) for s in (0, 2) for n in range(35)]
    df = spark.createDataFrame(rows, "doc_id bigint, chunk_index int, _s int, card_no int").withColumn("card_ord", plan.ordinal())
    assert [tuple(r)[:4] for r in df.orderBy("card_ord").collect()] == sorted(rows) and df.select("card_ord").distinct().count() == len(rows)


def test_template_files(spark, tmp_path):
    (tmp_path / "b.j2").write_text("{{ text | truncate_words(2) }} / {{ text | clean_text }}")
    (tmp_path / "a.j2").write_text("x")
    assert templates.template_files(str(tmp_path)) == ["a.j2", "b.j2"] and templates.template_files(str(tmp_path / "none")) == []
    p = templates.template_file(str(tmp_path), "b.j2")
    assert spark.createDataFrame([('one  "two"\nthree',)], "t string").select(templates.render(p, text=F.col("t"))).first()[0] == "one \"two\"... / one 'two' three"
    with pytest.raises(OSError):
        templates.template_file(str(tmp_path), "c.j2")


def test_registry_file(spark, tmp_path):
    path = str(tmp_path / "documents.yaml")
    assert registry_file.load_registry(spark, path).count() == 0
    (tmp_path / "documents.yaml").write_text("""
version: "1.0"
documents:
  b.pdf: {file_path: in/b.pdf, enabled: false, metadata: {page_count: 12, doc_type: textbook, has_doi: true}, override_chunking: {mode: smart, tokens_per_chunk: 900}, override_strategies: [key_points]}
  a.pdf: {file_path: in/a.pdf}
""")
    first = registry_file.load_registry(spark, path)
    a, b = sorted(first.collect(), key=lambda r: r["key"])
    assert (a["enabled"], a["page_count"], b["enabled"], b["doc_type"], b["override_tokens_per_chunk"], b["override_strategies"], b["heuristic_mode"]) == (True, None, False, "textbook", 900, ["key_points"], None)
    registry_file.save_registry(first, str(tmp_path / "again.yaml"))
    again = registry_file.load_registry(spark, str(tmp_path / "again.yaml"))
    assert sorted(map(tuple, again.collect()), key=lambda r: r[0]) == sorted(map(tuple, first.collect()), key=lambda r: r[0])


def test_extraction_of_everything(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.pdf").write_text("x")
    (tmp_path / "in/bad.pdf").write_text("!")

    def extractor(path, raw):
        if raw == b"!":
            raise ValueError
        line = lambda t, size, flags=0: [{"text": t, "font": "f", "size": size, "flags": flags, "color": 0}]
        pages = [{"raw_text": f"page {n}", "bbox": [0, 0, 9.0, 9.0], "rotation": 0, "blocks": [
            {"type": 0, "bbox": [1, 1, 2, 2], "lines": [line("A Big Title", 20.0), line("plain text here.", 10.0), line("  ", 10.0)]}, {"type": 1, "bbox": [0, 0, 1, 1], "width": 300, "height": 200}, {"type": 0, "lines": [line(" ", 9.0)]}, {"type": 7}]} for n in (1, 2)]
        images = [{"page_num": 1, "image_index": k, "width": w, "height": 100, "content": b"img", "rects": r} for k, w, r in ((0, 100, [[1, 2, 3, 4], [5, 6, 7, 8]]), (1, 99, []), (2, 400, []))]
        return {"metadata": {"author": "me", "creationDate": "D:1", "subject": ""}, "pages": pages, "images": images, "toc": True}

    c = content.extract(spark, [str(tmp_path / "in")], extractor)
    f = c.files.collect()
    assert len(f) == 1 and (f[0]["title"], f[0]["author"], f[0]["subject"], f[0]["creation_date"], f[0]["modification_date"], f[0]["page_count"]) == ("one", "me", "", "D:1", "", 2)
    assert [r["raw_text"] for r in c.pages.orderBy("page_num").collect()] == ["page 1", "page 2"]
    assert [(r["page_num"], r["type"], r["lines"]) for r in c.blocks.orderBy("page_num", "block_no").collect()] == [(p, *x) for p in (1, 2) for x in (("text", ["A Big Title", "plain text here."]), ("image", None))]
    assert sorted((r["image_index"], r["bbox"]) for r in c.images.collect()) == [(0, [1.0, 2.0, 3.0, 4.0]), (2, [0.0, 0.0, 9.0, 9.0])]
    assert {r["filename"] for r in c.images.collect()} == {f"img_p1_{k}_{hashlib.md5(b'img').hexdigest()[:12]}.png" for k in (0, 2)}
    assert [r["text"] for r in c.headings.orderBy("ord").collect()] == ["A Big Title"] * 2 and c.sections.count() == 2 and c.chapters.count() == 2
    assert c.hashes.first()["text_hash"] == hashlib.sha256(b"page 1page 2").hexdigest()[:16] and c.profiles.first()["toc_present"]
    assert content.extract(spark, [str(tmp_path / "in")], extractor, images=False, first=2).images.count() == 0


def test_recognised_texts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("full", "scan", "none", "torn"):
        (tmp_path / f"in/{name}.pdf").write_text(name)

    def extractor(path, raw):
        return {"pages": {b"full": [{"raw_text": "said"}, {"raw_text": ""}], b"scan": [{"raw_text": " \u3000\n", "rotation": 90}], b"none": [], b"torn": [{"raw_text": None}]}[raw]}

    def ocr(path, raw):
        if raw == b"torn":
            raise OSError("no engine")
        return {b"scan": ["read", "more"], b"none": []}[raw]

    name = lambda r: r["path"].rsplit("/", 1)[1][:-4]
    read = lambda **how: content.extract(spark, [str(tmp_path / "in")], extractor, **how)
    with pytest.warns(UserWarning, match="3 files have no text"):
        c = read(ocr_fallback=True)
    assert sorted(map(name, c.textless.collect())) == ["none", "scan", "torn"]
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert sorted(map(name, read(ocr=ocr).textless.collect())) == ["none", "scan", "torn"]  # not asked for
        c = read(ocr_fallback=True, ocr=ocr)
    assert sorted(map(name, c.textless.collect())) == ["none", "torn"]
    assert sorted((name(r), r["page_num"], r["raw_text"], r["rotation"]) for r in c.pages.where("raw_text > ''").collect()) == [("full", 1, "said", None), ("scan", 1, "read", 90), ("scan", 2, "more", None)]
    assert {name(r): r["page_count"] for r in c.files.collect()} == {"full": 2, "scan": 2, "none": 0, "torn": 1}


def test_small_parts(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "ab"), (2, ""), (3, "abc")], "chunk_id bigint, text string")
    got = retrieval.embedded(chunks, lambda texts: [[len(t), 1] if t else None for t in texts])
    assert sorted((r["vec_id"], r["embedding"]) for r in got.collect()) == [(1, [2.0, 1.0]), (3, [3.0, 1.0])]
    scored = spark.createDataFrame([(1, "a", 4.0), (2, "a", 5.0), (3, "a", None), (4, "b", 1.0), (5, "c", 1.0)], "card_ord bigint, strategy string, review_score double")
    kept = cards.of_quality(scored, {"a": 5, "b": None})
    assert sorted(r["card_ord"] for r in kept.collect()) == [2, 3, 4, 5] and cards.of_quality(scored, {}).count() == 5
    asked = spark.createDataFrame([("k1", 1), ("k2", 2), ("k2", 3), ("k1", 4)], "key string, n int")
    hits, todo = generation.split_cached(asked, spark.createDataFrame([("k1", "kept"), ("k9", "other")], "key string, content string"))
    assert sorted((r["n"], r["content"]) for r in hits.collect()) == [(1, "kept"), (4, "kept")] and [r["key"] for r in todo.collect()] == ["k2"]
    events = spark.sql("SELECT * FROM VALUES ('scan', timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:00:09'), ('scan', timestamp'2024-01-02 00:00:00', timestamp'2024-01-02 00:00:01.5'), ('open', timestamp'2024-01-01 00:00:00', NULL) t(phase, start, end)")
    assert {r["phase"]: r["seconds"] for r in telemetry.phases(events).collect()} == {"scan": 1.5, "open": None}
    images = spark.createDataFrame([("b.png", bytearray(b"2"), 1), ("a.png", bytearray(b"1"), 2)], "filename string, content binary, page_num int")
    sinks.save_images(images, str(tmp_path / "images"))
    assert sinks.export_images(spark, str(tmp_path / "images"), str(tmp_path / "out")) == ["a.png", "b.png"] and (tmp_path / "out/a.png").read_bytes() == b"1"
    sinks.save_index(spark.createDataFrame([("h1",), ("h2",)], "content_hash string"), str(tmp_path / "index"))
    assert sorted(r["content_hash"] for r in files.dedup_index(spark, str(tmp_path / "index")).collect()) == ["h1", "h2"]


@pytest.mark.parametrize("mode", chunking.MODES)
def test_texts_cut_in_every_mode(spark, mode):
    texts = spark.createDataFrame([(1, "One para.\n\nAnother para of it."), (2, None), (3, " \n ")], "doc_id bigint, text string")
    none = {"headings": spark.createDataFrame([], "doc_id bigint, ord int, text string, page int, level int"), "sections": spark.createDataFrame([], "doc_id bigint, sec_no int, title string, start_page int, end_page int")}
    got = chunking.chunk_texts(mode, texts, 4, least=1, **none).collect()
    assert {r["doc_id"] for r in got} == {1} and "\n\n".join(r["text"] for r in sorted(got, key=lambda r: r["chunk_index"])) == "One para.\n\nAnother para of it."
    if mode != "entire":
        assert {(r["start_page"], r["end_page"]) for r in got} == {(4, 4)}
    if mode not in ("pages", "paragraphs", "entire"):
        with pytest.raises(ValueError):
            chunking.chunk_texts(mode, texts)


def test_model_calls(spark):
    waits, said = [], iter([ValueError("down"), ("no json", 1, 1), ('{"a": 1}', 2, 3)])

    def model(system, prompt):
        x = next(said)
        if isinstance(x, Exception):
            raise x
        return x

    got = generation.call(model, "p", json_mode=True, wait=waits.append)
    assert (got["content"], got["attempts"], got["tokens_in"], got["tokens_out"], waits) == ('{"a": 1}', 3, 3, 4, [1.0])

    def broken(system, prompt):
        raise OSError("gone")

    waits.clear()
    got = generation.call(broken, "p", retries=2, wait=waits.append)
    assert got["content"] is None and "gone" in got["error"] and waits == [1.0, 2.0]
    rows = generation.responses(spark.createDataFrame([("k1", "hello"), ("k2", "fail")], "key string, prompt string"), lambda s, p: (p.upper(), 1, 2) if p == "hello" else broken(s, p), wait=lambda x: None).collect()
    assert {(r["key"], r["content"], r["attempts"]) for r in rows} == {("k1", "HELLO", 1), ("k2", None, 4)}
    with pytest.raises(ValueError):
        generation.provider(Llm(provider="anthropic"))
    generation.register_provider("anthropic", lambda settings: lambda s, p: (settings.model, 0, 0))
    assert generation.provider(Llm(provider="anthropic", model="m"))(None, "")[0] == "m"


def test_reviews_lose_no_card(spark):
    cards = spark.createDataFrame([(1, "a", "good"), (2, "b", "bad"), (3, "c", "error")], "card_ord bigint, id string, front string")

    def model(system, prompt):
        if prompt == "error":
            raise OSError
        return (json.dumps({"score": 8, "issues": ["x"], "edited": {"front": "better"}}) if prompt == "good" else "[]"), 1, 1

    got = {r["card_ord"]: (r["id"], r["score"], r["edit_front"]) for r in generation.reviews(cards, model, F.col("front"), wait=lambda x: None).collect()}
    assert got == {1: ("a", 8.0, "better"), 2: ("b", 5.0, None), 3: ("c", 5.0, None)}


def test_deck_from_a_saved_table(spark, tmp_path):
    rows = [("a1", "Basic", "f", "b", ""), ("c1", "Cloze", "", "", "{{c1::x}}"), ("o1", "Other", "", "", "")]
    cards = spark.createDataFrame(rows, "id string, note_type string, front string, back string, cloze_text string").withColumns({"strategy": F.lit("key_points"), "tags": F.array(F.lit("t"))})
    sinks.save_cards(cards, str(tmp_path / "csv"))
    got = build.build_deck(spark, Config(), str(tmp_path / "csv"), str(tmp_path / "deck"))
    assert (got["total_cards"], got["skipped"], got["decks"], got["note_types"], got["strategies"]) == (2, 1, ["Leafmill"], ["Basic", "Cloze", "Other"], ["key_points"])
    assert spark.read.parquet(str(tmp_path / "deck/note_types")).count() == 2
    assert sinks.backup(spark, str(tmp_path / "deck")) and spark.read.parquet(str(tmp_path / "deck.bak/notes")).count() == 2 and sinks.backup(spark, str(tmp_path / "no")) is None
    assert sinks.clear_cache(spark, str(tmp_path / "deck/notes")) == 2 and sinks.clear_cache(spark, str(tmp_path / "deck/notes")) == 0
    assert [t["model_id"] for t in deck.note_types()] == [t["model_id"] for t in deck.note_types()] and [len(t["fields"]) for t in deck.note_types()] == [7, 6]
    sinks.save_index(spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<double>"), str(tmp_path / "v"))
    assert files.vector_index(spark, str(tmp_path / "v")).count() == 1 and files.vector_index(spark, str(tmp_path / "w")).count() == 0


def test_samples(spark):
    pages = spark.createDataFrame([(1, 1, "first line\nsecond\nthird"), (1, 9, "late"), (2, 1, "other")], "doc_id bigint, page_num int, raw_text string")
    with pytest.raises(ValueError):
        build.samples(pages, ["key_points"])  # nobody is there to ask
    got = build.samples(pages, ["key_points", "cloze_definitions"], ask=cards.mock_responses)
    assert {(r["doc_id"], r["strategy"]): r["count"] for r in got.groupBy("doc_id", "strategy").count().collect()} == {(1, "key_points"): 2, (1, "cloze_definitions"): 2, (2, "key_points"): 1, (2, "cloze_definitions"): 1}
