"""Saved card tables read again: row order, ids, previews, warnings, reports and decks agree with a pass over the files."""

import csv
import glob

import pytest
from pyspark.sql import functions as F

from leafmill.operators import deck, identity, validate
from leafmill.plans import build
from leafmill.plans.config import Config
from leafmill.sources import files, sinks

SCHEMA = "card_ord bigint, id string, note_type string, front string, back string, cloze_text string, extra string, source_pdf string, page_start int, page_end int, section string, strategy string, core_concept string, tags array<string>, media array<string>"


def rows(n=200):
    out = []
    for i in range(n):
        cloze = i % 3 == 0
        out.append((
            1000 - i, "x" if i % 17 == 0 else f"s_{i:06d}" if i % 5 else "", "Other" if i % 50 == 49 else "Cloze" if cloze else "Basic", "" if cloze else f'line one of {i}\nline "two", with signs;', "" if cloze else f"back {i}",
            "{{c1::a}} " * (7 if i % 9 == 0 else 1) if cloze else "", None if i % 4 else "more", f"in/f{i % 3}.pdf" if i % 8 else None, i % 6 if i % 10 else None, i % 6 + i % 2 if i % 7 else None, f"S{i % 2}" if i % 5 else "",
            "key_points", f"C{i % 40}", [f"t{k}" for k in range(i % 6)], ["a.png", "b.png"] if i % 10 == 0 else [],
        ))
    return out


@pytest.fixture(scope="module", params=[True, False])
def saved(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("saved") / "csv")
    df = spark.createDataFrame(rows(), SCHEMA)
    sinks.save_cards(df if request.param else df.repartition(3), path, single=request.param)
    found = []
    for f in sorted(glob.glob(path + "/part-*")):
        with open(f, newline="", encoding="utf-8") as h:
            found += list(csv.DictReader(h))
    assert len(found) == 200 and [r["front"] for r in found] == [r[3] for r in sorted(rows())]
    return files.cards_csv(spark, path), found, path


def test_order(saved):
    cards, found, _ = saved
    got = cards.orderBy("card_ord").collect()
    assert [r["card_ord"] for r in got] == list(range(200)) and [(r["front"] or "", r["id"] or "") for r in got] == [(r["front"], r["id"]) for r in found]
    # the place is the row's, whatever is read of it
    assert {(r["card_ord"], r["id"] or "") for r in cards.select("id", "card_ord").where("card_ord % 7 = 3").collect()} == {(i, r["id"]) for i, r in enumerate(found) if i % 7 == 3}


def test_ids_previews_and_warnings(saved):
    cards, found, _ = saved
    want = {}
    for r in found:
        if r["id"]:
            want["|".join(r[c] for c in ("source_pdf", "page_start", "core_concept", "note_type", "strategy"))] = r["id"]
    assert {r["key"]: r["id"] for r in identity.known_ids(cards).collect()} == want
    shown = [(r["card_ord"], r["short_id"] or "", r["pages"], r["tags"]) for r in deck.previews(cards, 12).collect()]

    def tags(r):
        t = [x for x in r["tags"].split(";") if x]
        return ", ".join(t[:3]) + (f" (+{len(t) - 3})" if len(t) > 3 else "")

    assert shown == [(i, r["id"][:12], f"{r['page_start']}-{r['page_end'] or '?'}" if r["page_start"] else "", tags(r)) for i, r in enumerate(found[:12])]
    got = sorted((r["row"], r["rule"]) for r in validate.row_warnings(cards).collect())
    assert got == sorted([(i, "short_id") for i, r in enumerate(found) if 0 < len(r["id"]) < 4] + [(i, "many_cloze") for i, r in enumerate(found) if r["note_type"] == "Cloze" and r["cloze_text"].count("{{c") > 5])


def test_report_and_issues(spark, saved):
    cards, found, _ = saved
    media = spark.createDataFrame([("a.png",)], "name string")
    r = validate.report(cards, media).first()
    assert (r["valid"], r["total_rows"], r["note_types"], r["media_files"]) == (False, 200, ["Basic", "Cloze", "Other"], 2)
    n = {(x["rule"], x["field"]): x["n"] for x in validate.issues(cards, media).collect()}
    assert n["empty_id", "id"] == sum(not x["id"] for x in found) and n["missing_media", "media"] == 1 and n["unknown_note_type", "note_type"] == sum(x["note_type"] == "Other" for x in found)
    assert n["empty_column", "deck"] == 1  # no card has a deck


def test_a_needed_column_that_is_missing_is_an_error(spark):
    basic = spark.createDataFrame([("id01", "Basic", "b"), ("id02", "Basic", "b")], "id string, note_type string, back string").withColumns({"deck": F.lit("D"), "tags": F.lit("t"), "media": F.lit("m")})
    found = {(x["severity"], x["rule"], x["field"], x["note_type"], x["n"]) for x in validate.issues(basic).collect()}
    assert ("error", "missing_field", "front", "Basic", 2) in found and not any(r == "missing_field" and t == "Cloze" for _, r, _, t, _ in found)
    assert validate.report(basic).first()["valid"] is False
    odd = basic.withColumns({"front": F.lit("    "), "id": F.lit("  ")})
    rules = {(x["rule"], x["field"]) for x in validate.issues(odd).collect()}
    assert {("short_content", "front"), ("empty_field", "front"), ("id_length", "id")} <= rules


def test_notes_have_their_types_fields(spark, saved, tmp_path):
    cards, found, path = saved
    notes = {r["guid"]: r for r in deck.notes(cards.where("id <> ''"), "D", "by_chapter").collect()}
    kinds = {t["kind"]: t["fields"] for t in deck.note_types()}
    seen = 0
    for r in found:
        if not r["id"] or r["id"] == "x" or r["note_type"] == "Other":
            continue
        note = notes[r["id"]]
        f = dict(zip(kinds[note["model"]], note["fields"], strict=True))
        a, b = (x if x not in ("", "0") else "" for x in (r["page_start"], r["page_end"]))
        assert f["Source"] == (r["source_pdf"].split("/")[-1] or "Unknown") and f["Section"] == r["section"] and f["Extra"] == r["extra"]
        assert f["Page"] == ("" if not a else f"p. {a}" if not b or a == b else f"pp. {a}-{b}")
        assert f["Tags"] == ";".join(note["tags"]) and f"type:{note['model'].lower()}" in note["tags"]
        assert (f["Front"], f["Back"]) == (r["front"], r["back"]) if note["model"] == "Basic" else f["Text"] == r["cloze_text"]
        seen += 1
    assert seen > 100
    got = build.build_deck(spark, Config(), path, str(tmp_path / "deck"))
    assert (got["total_cards"], got["skipped"]) == (sum(r["note_type"] != "Other" for r in found), sum(r["note_type"] == "Other" for r in found))


def test_ordinals_of_many_files(spark, tmp_path):
    for k, n in (("b", 3), ("a", 2), ("c", 0), ("d", 1)):
        (tmp_path / f"{k}.csv").write_text("id\n" + "".join(f"{k}{i}\n" for i in range(n)))
    df = files.with_ordinals(spark.read.option("header", True).csv(str(tmp_path)), "at")
    assert [r["id"] for r in df.orderBy("at").collect()] == ["a0", "a1", "b0", "b1", "b2", "d0"] and [r["at"] for r in df.orderBy("at").collect()] == list(range(6))
    assert files.with_ordinals(spark.read.schema("id string").option("header", True).csv(str(tmp_path / "c.csv"))).count() == 0


def test_a_large_file_read_in_parts_keeps_its_order(spark, tmp_path):
    (tmp_path / "big.csv").write_text("".join(f"{i},{'x' * 50}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = spark.read.schema("n int, t string").csv(str(tmp_path / "big.csv"))
        assert df.rdd.getNumPartitions() > 4
        assert files.with_ordinals(df, "at").where("n <> at").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
