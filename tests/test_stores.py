"""Data sources, stored tables in buckets, state over streams, and chunks of documents that no row holds."""

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import chunking, large, registry
from leafmill.sources import index_store, paged_source
from leafmill.streaming import first_wins

CARD = "card_ord bigint, note_type string, front string, back string, cloze_text string, extra string"


class Pages:
    """Pages between form feeds; each page that is looked at leaves a mark."""

    def __init__(self, path, content):
        if content == b"bad":
            raise ValueError
        self.path, self.texts = path, content.decode().split("\f")

    def __len__(self):
        return len(self.texts)

    def __getitem__(self, i):
        with open(os.path.join(os.path.dirname(self.path), "seen", f"{os.path.basename(self.path)}-{i + 1}"), "w"):
            pass
        return self.texts[i]


@pytest.fixture()
def opener(spark, tmp_path):
    """The class above as a module that the workers can import."""
    import inspect

    (tmp_path / "openers.py").write_text("import os\n\n\n" + inspect.getsource(Pages))
    name = f"openers_{abs(hash(str(tmp_path)))}"
    os.rename(tmp_path / "openers.py", tmp_path / f"{name}.py")
    spark.sparkContext.addPyFile(str(tmp_path / f"{name}.py"))
    (tmp_path / "in/seen").mkdir(parents=True)
    return f"{name}:Pages"


def test_only_asked_pages_are_read(spark, tmp_path, opener):
    paged_source.register(spark)
    for n, pages in (("a.txt", 9), ("b.txt", 40), ("c.txt", 1)):
        (tmp_path / "in" / n).write_text("\f".join(f"{n} page {i}" for i in range(1, pages + 1)))
    (tmp_path / "in/bad.txt").write_text("bad")
    (tmp_path / "in/x.pdf").write_text("no")
    read = lambda **o: spark.read.format("paged_files").options(path=str(tmp_path / "in"), pattern="*.txt", opener=opener, **o).load()
    seen = lambda: sorted(p.name for p in (tmp_path / "in/seen").iterdir())
    few = read(partition_bytes=200, batch_rows=2).where("page_num >= 3 and page_num < 6")
    got = sorted((os.path.basename(r["path"]), r["page_num"], r["raw_text"]) for r in few.collect())
    assert got == [(n, i, f"{n} page {i}") for n in ("a.txt", "b.txt") for i in (3, 4, 5)]
    assert seen() == sorted(f"{n}-{i}" for n in ("a.txt", "b.txt") for i in (3, 4, 5))
    assert "page_num" in few._jdf.queryExecution().executedPlan().toString() and read(partition_bytes=200).rdd.getNumPartitions() > 3
    whole = read(partition_bytes=150)
    assert whole.count() == 50 and whole.select("path", "page_num").distinct().count() == 50
    a = str(tmp_path / "in/a.txt")
    assert {r["page_num"] for r in read().where((F.col("path") == a) & F.col("page_num").isin(2, 4)).collect()} == {2, 4}
    assert read().where("page_num = 99").count() == 0 and read().where(F.col("path") == "none").count() == 0


def test_files_appear_whole_or_not_at_all(spark, tmp_path):
    paged_source.register(spark)
    out = tmp_path / "images"
    df = spark.range(40).repartition(4).select(F.format_string("i%02d.png", "id").alias("filename"), F.encode(F.col("id").cast("string"), "utf-8").alias("content"))
    save = lambda d, mode="append": d.write.format("file_folder").option("path", str(out)).mode(mode).save()
    save(df)
    assert sorted(p.name for p in out.iterdir()) == [f"i{i:02d}.png" for i in range(40)] and (out / "i07.png").read_bytes() == b"7"
    with pytest.raises(Exception):  # noqa: B017, PT011  whatever Spark makes of the task's error
        save(df.withColumn("filename", F.when(F.col("filename") == "i33.png", "no/name").otherwise(F.col("filename"))), "overwrite")
    with pytest.raises(Exception):  # noqa: B017, PT011
        save(df)  # there already
    with pytest.raises(Exception):  # noqa: B017, PT011
        save(df.withColumn("filename", F.lit("same")), "overwrite")
    assert len(list(out.iterdir())) == 40 and [p.name for p in tmp_path.iterdir()] == ["images"]
    save(df.where("filename < 'i05'"), "overwrite")
    assert len(list(out.iterdir())) == 5 and [p.name for p in tmp_path.iterdir()] == ["images"]


def cards(spark, fronts, start=0):
    return spark.createDataFrame([(start + i, "Basic", f, "b", "", "") for i, f in enumerate(fronts)], CARD)


def test_an_index_reads_only_buckets_with_possible_hits(spark, tmp_path):
    index = index_store.HashIndex(spark, str(tmp_path / "index"), buckets=64)
    first = index.new_cards(cards(spark, [f"card {i}" for i in range(300)] + ["CARD  7", "card 7"]))
    assert first.count() == 300 and index.add(first) == 1
    h = index.rows()
    assert h.count() == 300 and len(index.pointer()) == len({r["b"] for r in h.select(index.bucket().alias("b")).collect()})
    asked = cards(spark, ["card 5", "brand new"], 1000)
    c = asked.withColumn("content_hash", index_store.content_hash(index_store.comparison_text()))
    reached = index.reached(c.select("content_hash"))
    known = c.where("front = 'card 5'").select(index.bucket().alias("b")).first()["b"]
    assert known in reached and len(reached) <= 2
    assert {f.split("bucket=")[1].split("/")[0] for f in index.rows(reached).inputFiles()} == {str(b) for b in reached}
    before = {p: os.path.getmtime(p) for p in glob.glob(str(tmp_path / "index/data/**/*.parquet"), recursive=True)}
    fresh = index.new_cards(asked)
    assert [r["front"] for r in fresh.collect()] == ["brand new"] and index.add(fresh) == 2 and index.rows().count() == 301
    assert all(os.path.getmtime(p) == t for p, t in before.items())
    # no card is lost or kept twice over many runs
    r = random.Random(4)
    seen = {f"card {i}" for i in range(300)} | {"brand new"}
    for k in range(4):
        fronts = [f"card {r.randrange(600)}" for _ in range(80)]
        left = index.new_cards(cards(spark, fronts, 2000 * (k + 1)))
        assert sorted(x["front"] for x in left.collect()) == sorted(set(fronts) - seen)
        seen |= set(fronts)
        index.add(left)
    v = index.version()
    assert index.add(left.limit(0)) == v and index.new_cards(cards(spark, [])).count() == 0


def test_a_registry_rewrites_only_touched_buckets(spark, tmp_path):
    scan = lambda keys, day: spark.createDataFrame([(k, "paper", n, day) for n, k in enumerate(keys)], "key string, doc_type string, page_count int, last_scanned string")
    store = index_store.StoredRegistry(spark, str(tmp_path / "reg"), buckets=16)
    assert store.rows().count() == 0 and store.upsert(scan([f"f{i}" for i in range(100)], "day1")) == 1
    before = store.pointer()
    whole = registry.upserted(store.rows(), scan(["f3", "new"], "day2")).collect()
    assert store.upsert(scan(["f3", "new"], "day2")) == 2
    after = store.pointer()
    assert sorted(map(tuple, store.rows().collect())) == sorted(map(tuple, whole)) and len(whole) == 101
    assert 1 <= sum(before.get(b) != after[b] for b in after) <= 2
    # a pointer that was not written to its end doesn't count
    os.makedirs(tmp_path / "reg/pointer/000000000009")
    assert store.version() == 2 and store.rows().count() == 101 and store.upsert(scan([], "day3")) == 2


def test_state_keeps_the_first_of_each_content(spark, tmp_path):
    put = lambda rows: spark.createDataFrame([(i, "Basic", f, "b", "", "") for i, f in rows], CARD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: first_wins.run(spark.readStream.schema(CARD).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    put([(3, "x"), (1, "x"), (2, "X "), (4, "y")])
    run()
    put([(5, "x"), (0, "y"), (7, "z"), (6, "z")])
    run()
    run()  # nothing new has come
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["card_ord"] for r in out.collect()) == [1, 4, 6] and set(out.columns) == {*CARD.replace("bigint", "").replace("string", "").replace(",", "").split(), "content_hash"}


@pytest.mark.parametrize("budget", [5, 30, 400])
def test_large_documents_give_the_same_chunks(spark, budget):
    r = random.Random(7)
    page = lambda: "\n\n".join(" ".join(r.choice(["word", "other", "sentence. Next"]) for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 4)))
    rows = [(d, p, r.choice([None, "", "  \n", page(), page(), page(), page()])) for d in [*range(6), None] for p in range(1, r.choice([2, 5, 60]))]
    df = spark.createDataFrame(rows, "doc_id bigint, page_num int, raw_text string").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # runs go on from batch to batch
    try:
        for mine, theirs in ((large.by_pages, chunking.by_pages), (large.by_paragraphs, chunking.by_paragraphs)):
            a, b = mine(df, budget), theirs(df, budget)
            assert set(a.columns) == set(b.columns)
            rows_of = lambda x: sorted(json.dumps([y[c] for c in sorted(b.columns)]) for y in x.collect())  # noqa: E731, B023
            assert rows_of(a) == rows_of(b)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert large.by_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("budget,overlap", [(5, 200), (30, 16), (100, 2), (100, 0)])
def test_large_documents_by_sections_and_smart(spark, budget, overlap):
    r = random.Random(budget + overlap)
    page = lambda: "\n\n".join(" ".join(r.choice(["word", "other\u00a0x", "sentence. Next"]) for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 4)))
    rows = [(d, p, r.choice([None, "", "  \n", page(), page(), page(), page()])) for d in [*range(7), None] for p in range(1, {0: 2, 1: 5}.get(d, 40))]
    df = spark.createDataFrame(rows, "doc_id bigint, page_num int, raw_text string").repartition(5)
    # none, few and many sections; overlapping ones, one twice, one beyond the pages, one backwards, one without an end
    secs = [(d, k, f"S{k}", a, b) for d, n in ((0, 1), (1, 3), (2, 2), (3, 9), (4, 5)) for k in range(n) for a in [r.randint(1, 30)] for b in [r.choice([a, a + 3, 2_000_000_000, a - 2])]]
    secs += [secs[-1], (4, 77, None, 1, None), (4, 77, None, 1, 2), (9, 1, "no pages", 1, 2)]
    sections = spark.createDataFrame(secs, "doc_id bigint, sec_no int, title string, start_page int, end_page int")
    headings = spark.createDataFrame([(d, o, f"H{o}", r.randint(1, 40), r.choice([1, 2, 3])) for d in range(7) for o in range(r.randint(0, 12))], "doc_id bigint, ord int, text string, page int, level int")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for mode in ("sections", "smart"):
            a, b = (m.chunk(mode, df, headings, sections, budget, overlap, most=2 * budget) for m in (large, chunking))
            assert set(a.columns) == set(b.columns)
            rows_of = lambda x: sorted(json.dumps([y[c] for c in sorted(b.columns)]) for y in x.collect())  # noqa: E731, B023
            assert len(got := rows_of(a)) > 20 and got == rows_of(b)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert large.smart(df.limit(0), headings, sections).count() == 0
