"""The pipeline's stages keep their contract; queries are all registered."""

import corpus_pipeline


def test_stages(spark, tmp_path):
    base = "\n".join(f"the house and water number {i} of the long story" for i in range(8))
    rows = [(0, base, "en", "s", 1), (1, base.replace("number 3", "figure 3"), "en", "s", 1), (2, None, "en", "s", 0), (3, "12 34", "en", "s", 5), (4, "a passage of the benchmark that stands in here with all its words", "en", "s", 9)]
    rows += [(i, f"other words {i} come and go {i * 7} for document {i} alone", "en", "s", 9) for i in range(10, 40)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "passage of the benchmark that stands in here with all its words")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        path = str(tmp_path / f"{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {2, 3}.isdisjoint(seen["language"]) and 0 in seen["lines"] and 4 in seen["near_duplicates"] and 4 not in seen["decontaminate"]
    assert seen["pack"] == seen["decontaminate"] >= set(range(10, 40)) | {0}


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_near_copies_of_four_fifths_go(spark, tmp_path):
    from leafmill.llm import minhash

    w = [f"w{i}" for i in range(270)]
    x = list(w)
    for i in (30, 80, 130, 180, 230):
        x[i] = f"other{i}"
    docs = spark.createDataFrame([(0, " ".join(w)), (1, " ".join(x)), (2, "quite another text of a few words")], "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()} == {0, 2}
    assert minhash.least_same(80) <= minhash.least_same(85) <= 14


def test_stages_on_nulls_repeats_and_nothing(spark, tmp_path):
    text = "some plain words of a document that stands alone in this table for the test of repeated rows"
    other = "quite another text of other words that has nothing in common with the first one at all here"
    rows = [(1, text, "en", "s", len(text), 7), (1, text, "en", "s", len(text), 7), (2, text, "en", "s", len(text), 8), (2, other, "en", "s", len(other), 8), (None, other, "en", None, None, 9), (3, None, "en", "s", 0, 1), (4, "", None, "s", 0, 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_removed bigint"
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, sf = spark.createDataFrame(rows, schema), str(tmp_path)
    kept = lambda f: sorted((str(r["doc_id"]), r["text"] or "") for r in f(spark, docs, sf).collect())
    every = sorted((str(r[0]), r[1] or "") for r in rows)
    assert kept(corpus_pipeline.language) == [x for x in every if x[1]]
    assert kept(corpus_pipeline.lines) == every and kept(corpus_pipeline.decontaminate) == every
    # the copy under id 2 goes, its other text stays; rows that repeat id and text stay together
    assert kept(corpus_pipeline.near_duplicates) == sorted(x for x in every if x != ("2", text))
    assert corpus_pipeline.pack(spark, docs, sf).count() == len(rows)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), sf).count() == 0
