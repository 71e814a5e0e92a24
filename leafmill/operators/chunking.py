"""Token-budgeted chunks of paged documents.

Chunks are contiguous runs of units (pages, paragraphs, detected sections) joined by blank lines, so a chunk is a pair
of unit numbers. A fold over the units' lengths finds the pairs inside the JVM; texts are joined only afterwards. One
shuffle by doc_id gathers a document's pages; nothing is compared across documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import let, strip, tokens, tokens_of_length

MODES = ("pages", "sections", "paragraphs", "smart", "figures", "highlights", "entire")
#: Headings behind which a paper's main part is over, and headings that open a section.
TERMINAL = ("References", "Bibliography", "Works Cited", "Appendix", "Supplementary Material", "Acknowledgments", "Acknowledgements")
SECTION_HEADS = (
    "Abstract|ABSTRACT", "Introduction|INTRODUCTION", "Methods|METHODS|Methodology|METHODOLOGY", "Results|RESULTS",
    "Discussion|DISCUSSION", "Conclusion|CONCLUSION|Conclusions|CONCLUSIONS", r"[0-9]+\.?\s+[A-Z][^.\n]*", r"[A-Z][A-Z\s]{3,}",
)


def pack_runs(lengths: Column, budget: int, carry: int = 0, joint: int = 2) -> Column:
    """array<struct<s,e>> (numbers from 0, both ends included) of greedy runs within ``budget`` tokens.

    ``carry``: how many units of a full run open the next one. With two, they are left out where they and the new unit
    wouldn't fit; with one they always stay. A unit that is too long alone is a run alone.
    """
    big, run = F.lit(0).cast("bigint"), "array<struct<s:int,e:int>>"
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("s"), big.alias("cur"), big.alias("p1"), big.alias("p2"), F.array().cast(run).alias("out"))

    def step(a: Column, n: Column) -> Column:
        n = n.cast("bigint")
        fresh = a["i"] == a["s"]
        whole = F.when(fresh, n).otherwise(a["cur"] + joint + n)
        over = ~fresh & (tokens_of_length(whole) > budget)
        two = (a["i"] - a["s"]) >= 2
        if carry == 0:
            start, cur = a["i"], n
        elif carry == 1:
            start, cur = a["i"] - 1, a["p1"] + joint + n
        else:
            kept = F.when(two, a["p2"] + joint + a["p1"]).otherwise(a["p1"]) + joint + n
            fits = tokens_of_length(kept) <= budget
            start = F.when(fits, a["i"] - F.when(two, 2).otherwise(1)).otherwise(a["i"])
            cur = F.when(fits, kept).otherwise(n)
        return F.struct(
            (a["i"] + 1).alias("i"), F.when(over, start).otherwise(a["s"]).cast("int").alias("s"), F.when(over, cur).otherwise(whole).alias("cur"), n.alias("p1"), a["p1"].alias("p2"),
            F.when(over, F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), (a["i"] - 1).alias("e"))))).otherwise(a["out"]).alias("out"),
        )

    def finish(a: Column) -> Column:
        return F.when(a["i"] > a["s"], F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), (a["i"] - 1).alias("e"))))).otherwise(a["out"])

    return F.aggregate(lengths, zero, step, finish)


def join_runs(units: Column, runs: Column, joint: str = "\n\n") -> Column:
    return F.transform(runs, lambda r: F.array_join(F.slice(units, r["s"] + 1, r["e"] - r["s"] + 1), joint))


def packed_texts(units: Column, budget: int, carry: int = 0, joint: str = "\n\n") -> Column:
    return let(units, lambda u: join_runs(u, pack_runs(F.transform(u, F.length), budget, carry, len(joint)), joint))


def paragraphs(text: Column, budget: int, longest: int = 1000) -> Column:
    """Paragraphs between blank lines; long ones as groups of sentences, joined by a full stop."""
    blocks = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")

    def groups(p: Column) -> Column:
        sentences = F.filter(F.split(p, r"[.!?]+\s+"), lambda s: strip(s) != "")
        return F.transform(packed_texts(sentences, budget, 0, ". "), strip)

    return F.flatten(F.transform(blocks, lambda p: F.when((F.length(p) > longest) | (tokens(p) > budget), groups(p)).otherwise(F.array(p))))


def split_text(text: Column, target: int, budget: int) -> Column:
    """A text as it is where it fits, else its paragraphs packed at ``target`` with up to two carried over."""
    return F.when(tokens(text) <= target, F.array(text)).otherwise(packed_texts(paragraphs(text, budget), target, carry=2))


def numbered(chunks: DataFrame, key: str = "doc_id", order: str = "_ord") -> DataFrame:
    """chunk_index and total_chunks in each document."""
    w = Window.partitionBy(key)
    return chunks.withColumn("chunk_index", F.row_number().over(w.orderBy(order)) - 1).withColumn("total_chunks", F.count(F.lit(1)).over(w).cast("int")).drop(order)


def _counts(df: DataFrame) -> DataFrame:
    return df.withColumn("token_count", tokens(F.col("text"))).withColumn("char_count", F.length("text")).withColumn("word_count", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))


def _gathered(pages: DataFrame, blank: bool = False) -> DataFrame:
    """doc_id, u: each document's pages (page_num, t) in order; the one shuffle of the texts."""
    t = F.coalesce("raw_text", F.lit(""))
    p = pages.select("doc_id", "page_num", (t if blank else strip(t)).alias("t"))
    return (p if blank else p.where("t <> ''")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "t"))).alias("u"))


def by_pages(pages: DataFrame, budget: int = 2000) -> DataFrame:
    """doc_id, chunk_index, total_chunks, text, start_page, end_page, token_count, char_count, word_count.

    Pages are packed in order; blank pages are skipped. A page over the budget is split on its own and does not close
    the run around it: its pieces come before the run that was open when it was met.
    """

    def piece(at: Column, kind: int, j: Column, text: Column, first: Column, last: Column) -> Column:
        return F.struct(F.struct(at.alias("at"), F.lit(kind).alias("k"), j.alias("j")).alias("_ord"), text.alias("text"), first.alias("start_page"), last.alias("end_page"))

    def run(u: Column, r: Column) -> Column:
        part = F.slice(u, r["s"] + 1, r["e"] - r["s"] + 1)
        closed = F.coalesce(F.get(u, r["e"] + 1)["page_num"], F.lit(2**31 - 1))
        return piece(closed, 1, F.lit(0), F.array_join(F.transform(part, lambda x: x["t"]), "\n\n"), F.get(u, r["s"])["page_num"], F.get(u, r["e"])["page_num"])

    fits = lambda x: tokens(x["t"]) <= budget
    runs = let(F.filter("u", fits), lambda u: F.transform(pack_runs(F.transform(u, lambda x: F.length(x["t"])), budget), lambda r: run(u, r)))
    cut = F.flatten(F.transform(F.filter("u", lambda x: ~fits(x)), lambda x: F.transform(split_text(x["t"], budget, budget), lambda t, j: piece(x["page_num"], 0, j, t, x["page_num"], x["page_num"]))))
    return _indexed(_gathered(pages), F.array_sort(F.concat(runs, cut)), "doc_id").drop("_ord")


def by_paragraphs(pages: DataFrame, budget: int = 2000, least: int = 100) -> DataFrame:
    """Paragraphs packed page by page; what is left of a page goes unless it has ``least`` tokens or is the last page."""

    def of_page(x: Column) -> Column:
        last = x["page_num"] == F.element_at("u", -1)["page_num"]
        kept = lambda t, i, texts: (i < F.size(texts) - 1) | last | (tokens(t) >= least)
        page = lambda t: F.struct(t.alias("text"), x["page_num"].alias("start_page"), x["page_num"].alias("end_page"))
        return let(packed_texts(paragraphs(x["t"], budget), budget), lambda texts: F.transform(F.filter(texts, lambda t, i: kept(t, i, texts)), page))

    return _indexed(_gathered(pages, blank=True), F.flatten(F.transform("u", of_page)), "doc_id")


def full_text(pages: DataFrame) -> DataFrame:
    """doc_id, text: all pages with text, in order."""
    return _gathered(pages).select("doc_id", F.array_join(F.transform("u", lambda x: x["t"]), "\n\n").alias("text"))


def trim_terminal(text: Column) -> Column:
    """The text up to its first terminal heading (on a line of its own, in any case)."""
    names = "|".join(TERMINAL)
    return strip(F.regexp_replace(text, rf"(?is)\n\s*({names})\s*\n.*$", "\n"))


def detected_sections(text: Column) -> Column:
    """array<struct<title,start_line,text>>: lines between section headings; what comes first is "Beginning". Sections
    without text are left out."""
    heads = "|".join(f"(?:{h})" for h in SECTION_HEADS)

    def cut(lines: Column, starts: Column) -> Column:
        def one(at: Column, k: Column) -> Column:
            until = F.coalesce(F.get(starts, k + 1), F.size(lines))
            title = F.when(at < 0, F.lit("Beginning")).otherwise(strip(F.get(lines, at)))
            body = F.array_join(F.slice(lines, at + 2, F.greatest(until - at - 1, F.lit(0))), "\n")
            return F.struct(title.alias("title"), F.greatest(at, F.lit(0)).alias("start_line"), strip(body).alias("text"))

        return F.filter(F.transform(starts, one), lambda x: x["text"] != "")

    def places(lines: Column) -> Column:
        found = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: strip(F.get(lines, i)).rlike(rf"^(?:{heads})\s*$"))
        return F.concat(F.array(F.lit(-1)), found)

    return let(F.split(text, "\n"), lambda lines: let(places(lines), lambda starts: cut(lines, starts)))


def section_boundaries(docs: DataFrame) -> DataFrame:
    """doc_id, sec_no, title, start_line, text of the detected sections; sec_no counts those that have text, from 0."""
    return docs.where("text is not null").select("doc_id", F.posexplode(detected_sections(F.col("text"))).alias("sec_no", "x")).select("doc_id", "sec_no", "x.*")


def _indexed(df: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """One row for each chunk of a document's array (structs), numbered by its place: nothing is shuffled or sorted."""
    rows = df.withColumn("_c", chunks).select(*keep, F.size("_c").alias("total_chunks"), F.posexplode("_c").alias("chunk_index", "_x"))
    return _counts(rows.select(*keep, "chunk_index", "total_chunks", "_x.*"))


def entire(docs: DataFrame, budget: int = 8000, tpc: int = 2000, trim: bool = True) -> DataFrame:
    """doc_id, page_count, text (one row a document) -> one chunk where it fits, else chunks of detected sections or of
    paragraphs. Each document is cut in its own row."""
    text = trim_terminal(F.col("text")) if trim else strip(F.col("text"))
    piece = lambda t, s: F.struct(t.alias("text"), s.alias("section"))

    def by_sections_of(u: Column) -> Column:
        def one(r: Column) -> Column:
            part = F.slice(u, r["s"] + 1, r["e"] - r["s"] + 1)
            return piece(F.array_join(F.transform(part, lambda x: x["text"]), "\n\n"), F.array_join(F.transform(part, lambda x: x["title"]), " + "))

        return F.transform(pack_runs(F.transform(u, lambda x: F.length(x["text"])), budget), one)

    def by_parts(t: Column) -> Column:
        return F.transform(packed_texts(paragraphs(t, tpc), budget, carry=1), lambda x, i: piece(x, F.concat(F.lit("Document Part "), (i + 1).cast("string"))))

    d = docs.select("doc_id", "page_count", text.alias("text")).where("text <> ''")
    t = F.col("text")
    chunks = F.when(tokens(t) <= budget, F.array(piece(t, F.lit("Entire Document")))).otherwise(let(detected_sections(t), lambda u: F.when(F.size(u) > 1, by_sections_of(u)).otherwise(by_parts(t))))
    return _indexed(d, chunks, "doc_id", "page_count").withColumn("start_page", F.lit(1)).withColumnRenamed("page_count", "end_page")


def section_text(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Each section (doc_id, sec_no, title, start_page, end_page) with its pages' text in order."""
    p = pages.select(F.col("doc_id").alias("_d"), "page_num", strip(F.coalesce("raw_text", F.lit(""))).alias("t")).where("t <> ''")
    j = sections.join(p, (F.col("doc_id") == F.col("_d")) & F.col("page_num").between(F.col("start_page"), F.col("end_page")))
    j = j.groupBy("doc_id", "sec_no", "title", "start_page", "end_page").agg(F.array_sort(F.collect_list(F.struct("page_num", "t"))).alias("u"))
    return j.withColumn("text", F.array_join(F.transform("u", lambda x: x["t"]), "\n\n")).drop("u")


def by_sections(sections: DataFrame, pages: DataFrame, target: int = 4000, budget: int = 2000) -> DataFrame:
    """Sections' texts, split where too long. Documents without sections are packed by pages.

    A document's pages and sections meet in one row, so a page is sent once, however many sections it lies in."""
    p = _gathered(pages)
    s = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sec_no", "title", "start_page", "end_page"))).alias("v"))

    def cut(x: Column) -> Column:
        inside = F.filter("u", lambda p: p["page_num"].between(x["start_page"], x["end_page"]))
        of = lambda t: F.struct(x["title"].alias("section"), x["start_page"].alias("start_page"), x["end_page"].alias("end_page"), t.alias("text"))
        return let(F.array_join(F.transform(inside, lambda p: p["t"]), "\n\n"), lambda t: F.transform(F.when(t == "", F.array().cast("array<string>")).otherwise(split_text(t, target, budget)), of))

    out = _indexed(s.join(p, "doc_id"), F.flatten(F.transform("v", cut)), "doc_id")
    rest = by_pages(pages.join(sections.select("doc_id").distinct(), "doc_id", "left_anti"), budget).withColumn("section", F.lit(None).cast("string"))
    return out.unionByName(rest)


def smart(pages: DataFrame, headings: DataFrame, sections: DataFrame, budget: int = 2000, overlap: int = 200, target: int = 4000, paragraph: int | None = None) -> DataFrame:
    """Three sections or more: by sections. Else pages packed with an overlap of words, and a new chunk at each heading.

    The overlap carries text from run to run, so the fold's state holds the open chunk's text.
    """
    rich = sections.groupBy("doc_id").count().where("count >= 3").select("doc_id")
    first = by_sections(sections.join(rich, "doc_id", "left_semi"), pages.join(rich, "doc_id", "left_semi"), target, paragraph or budget)
    top = headings.where("level <= 2").groupBy("doc_id", F.col("page").alias("page_num")).agg(F.min_by("text", "ord").alias("head"))
    p = pages.join(rich, "doc_id", "left_anti").join(top, ["doc_id", "page_num"], "left").select("doc_id", F.struct("page_num", strip(F.coalesce("raw_text", F.lit(""))).alias("t"), "head").alias("x")).where("x.t <> ''")
    p = p.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("u"))
    chunk = "struct<text:string,start_page:int,end_page:int,section:string>"
    none = F.lit(None)
    zero = F.struct(F.lit("").alias("text"), none.cast("int").alias("a"), none.cast("int").alias("b"), none.cast("string").alias("sec"), F.array().cast(f"array<{chunk}>").alias("out"))

    def tail(text: Column) -> Column:
        w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
        n = overlap // 4
        return let(w, lambda x: F.array_join(F.when(F.size(x) > n, F.slice(x, F.size(x) - n + 1, n)).otherwise(x) if n else x, " "))

    def step(s: Column, x: Column) -> Column:
        pot = F.when(s["text"] == "", x["t"]).otherwise(F.concat(s["text"], F.lit("\n\n"), x["t"]))
        filled = s["text"] != ""
        headed = x["head"].isNotNull() & filled
        over = (tokens(pot) > budget) & filled & ~headed
        flush = headed | over
        again = F.concat(tail(s["text"]), F.lit("\n\n"), x["t"]) if overlap > 0 else x["t"]
        done = F.concat(s["out"], F.array(F.struct(strip(s["text"]).alias("text"), s["a"].alias("start_page"), s["b"].alias("end_page"), s["sec"].alias("section"))))
        return F.struct(
            F.when(headed, x["t"]).when(over, again).otherwise(pot).alias("text"), F.when(flush | ~filled, x["page_num"]).otherwise(s["a"]).cast("int").alias("a"), x["page_num"].cast("int").alias("b"),
            F.when(headed, x["head"]).otherwise(F.coalesce(s["sec"], x["head"])).alias("sec"), F.when(flush, done).otherwise(s["out"]).alias("out"),
        )

    def finish(s: Column) -> Column:
        return F.when(s["text"] != "", F.concat(s["out"], F.array(F.struct(strip(s["text"]).alias("text"), s["a"].alias("start_page"), s["b"].alias("end_page"), s["sec"].alias("section"))))).otherwise(s["out"])

    c = p.select("doc_id", F.posexplode(F.aggregate("u", zero, step, finish)).alias("_ord", "c")).select("doc_id", "_ord", "c.*")
    return first.unionByName(_counts(numbered(c)))


def chunk_texts(mode: str, texts: DataFrame, start_page: int = 1, **how) -> DataFrame:
    """``chunk`` of texts (doc_id, text) that are one page each."""
    return chunk(mode, texts.select("doc_id", F.lit(start_page).alias("page_num"), F.col("text").alias("raw_text")), **how)


def chunk(mode: str, pages: DataFrame, headings: DataFrame | None = None, sections: DataFrame | None = None, budget: int = 2000, overlap: int = 200, least: int = 100, most: int = 4000, token_budget: int = 8000, trim: bool = True) -> DataFrame:
    """Chunks of all documents under one of ``MODES``; figures and highlights are cut as smart."""
    if mode not in MODES:
        raise ValueError(f"no chunking mode {mode!r}; there are {', '.join(MODES)}")
    if mode == "pages":
        return by_pages(pages, budget)
    if mode == "paragraphs":
        return by_paragraphs(pages, budget, least)
    if mode == "entire":
        n = pages.groupBy("doc_id").agg(F.max("page_num").alias("page_count"))
        return entire(full_text(pages).join(n, "doc_id"), token_budget, budget, trim)
    if headings is None or sections is None:
        raise ValueError(f"chunking mode {mode!r} needs headings and sections")
    return by_sections(sections, pages, most, budget) if mode == "sections" else smart(pages, headings, sections, budget, overlap, most)
