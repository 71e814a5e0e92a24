"""All queries outside the llm subpackage, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.functions.similarity import indel
from leafmill.operators import cards as cd
from leafmill.operators import chunking as ch
from leafmill.operators import deck, dedup, generation, identity, profile, registry, retrieval, structure, telemetry, validate
from leafmill.plans import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- SQL building blocks -------------------------------------------------------------------------------------------

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
COLLAPSE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
CLOZE_RE = r"\{\{c[0-9]+::[^}]+\}\}"


def strip(x: str) -> str:
    return STRIP.replace("{0}", x)


def collapse(x: str) -> str:
    return COLLAPSE.replace("{0}", x)


def uncloze(x: str) -> str:
    return r"regexp_replace(" + x + r", '\{\{c[0-9]+::(.*?)\}\}', '\1', 'g')"


def run_ctes(units: str, budget: int, carry: int, name: str = "runs", joint: int = 2) -> str:
    """CTEs that give k, s, e of greedy runs over ``units`` (k, i from 0, len), stepping row by row."""
    if carry == 0:
        start, cur = "i", "len"
    elif carry == 1:
        start, cur = "i - 1", f"p1 + {joint} + len"
    else:
        start, cur = "CASE WHEN kept // 4 <= T THEN i - CASE WHEN i - s >= 2 THEN 2 ELSE 1 END ELSE i END", "CASE WHEN kept // 4 <= T THEN kept ELSE len END"
    return f"""{name}_p(k, i, s, cur, p1, p2, opened) AS (
      SELECT k, i, CAST(0 AS BIGINT), CAST(len AS BIGINT), CAST(len AS BIGINT), CAST(0 AS BIGINT), TRUE FROM {units} WHERE i = 0
      UNION ALL SELECT k, i, CAST(CASE WHEN o THEN {start} ELSE s END AS BIGINT), CAST(CASE WHEN o THEN {cur} ELSE cur + {joint} + len END AS BIGINT), CAST(len AS BIGINT), p1, o
      FROM (SELECT u.k, u.i, u.len, p.s, p.cur, p.p1, {budget} AS T, (p.cur + {joint} + u.len) // 4 > {budget} AS o, CASE WHEN u.i - p.s >= 2 THEN p.p2 + {joint} + p.p1 ELSE p.p1 END + {joint} + u.len AS kept
            FROM {name}_p p JOIN {units} u ON u.k = p.k AND u.i = p.i + 1)),
    {name} AS (SELECT k, s, i AS e FROM (SELECT k, s, i, lead(opened) OVER (PARTITION BY k ORDER BY i) AS closed FROM {name}_p) WHERE coalesce(closed, TRUE))"""


def joined(units: str, runs: str, joint: str = "chr(10) || chr(10)") -> str:
    """k, s, e, text of runs over units (k, i, t)."""
    return f"SELECT r.k, r.s, r.e, string_agg(u.t, {joint} ORDER BY u.i) AS text FROM {runs} r JOIN {units} u ON u.k = r.k AND u.i BETWEEN r.s AND r.e GROUP BY r.k, r.s, r.e"


def paragraph_ctes(source: str, budget: int, name: str = "para") -> str:
    """CTE ``name`` (k, i, t, len): paragraphs of source (k, t); long ones as groups of sentences."""
    return rf"""{name}_b AS (SELECT k, b, {strip('p')} AS p FROM (SELECT k, unnest(string_split_regex(t, '\n\s*\n')) AS p, unnest(range(len(string_split_regex(t, '\n\s*\n')))) AS b FROM {source})),
    {name}_n AS (SELECT *, length(p) > 1000 OR length(p) // 4 > {budget} AS long FROM {name}_b WHERE p <> ''),
    {name}_s AS (SELECT k AS k0, b, x, row_number() OVER (PARTITION BY k, b ORDER BY j) - 1 AS i FROM (SELECT k, b, unnest(string_split_regex(p, '[.!?]+\s+')) AS x, unnest(range(len(string_split_regex(p, '[.!?]+\s+')))) AS j FROM {name}_n WHERE long) WHERE {strip('x')} <> ''),
    {name}_u AS (SELECT row(k0, b) AS k, i, x AS t, length(x) AS len FROM {name}_s),
    {run_ctes(name + '_u', budget, 0, name + '_r')},
    {name}_g AS ({joined(name + '_u', name + '_r', "'. '")}),
    {name}_a AS (SELECT k, b, 0 AS s, p AS t FROM {name}_n WHERE NOT long UNION ALL SELECT k[1], k[2], s, {strip('text')} FROM {name}_g),
    {name} AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY b, s) - 1 AS i, t, length(t) AS len FROM {name}_a)"""


# ---- chunking ------------------------------------------------------------------------------------------------------

PAGE_BUDGET, PARA_BUDGET, SPLIT_TARGET, WHOLE_BUDGET = 600, 150, 300, 900


def chunk_digest(df: DataFrame, *more: str) -> DataFrame:
    return df.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("total_chunks").cast("bigint").alias("total_chunks"), F.col("start_page").cast("bigint").alias("start_page"), F.col("end_page").cast("bigint").alias("end_page"), F.col("token_count").cast("bigint").alias("token_count"), F.md5(F.col("text").cast("binary")).alias("text_md5"), *more)


def pages_ctes(budget: int, n: str = "pk", keep: str = "TRUE") -> str:
    """CTE ``n`` (doc_id, text, start_page, end_page, o1, o2, o3) of the page packing of documents that ``keep`` holds for.

    Pages over the budget are cut on their own, before the run that was open when they came."""
    return f"""{n}_g AS (SELECT doc_id, page_num, {strip('raw_text')} AS t FROM pages WHERE {strip('raw_text')} <> '' AND {keep}),
{n}_small AS (SELECT doc_id AS k, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) - 1 AS i, page_num, t, length(t) AS len FROM {n}_g WHERE length(t) // 4 <= {budget}),
{n}_large AS (SELECT row(doc_id, page_num) AS k, t FROM {n}_g WHERE length(t) // 4 > {budget}),
{run_ctes(n + '_small', budget, 0, n + '_runs')},
{n}_a AS (SELECT j.k AS doc_id, j.text, x.page_num AS start_page, y.page_num AS end_page, coalesce(z.page_num, 2147483647) AS o1, 1 AS o2, 0 AS o3 FROM ({joined(n + '_small', n + '_runs')}) j
  JOIN {n}_small x ON x.k = j.k AND x.i = j.s JOIN {n}_small y ON y.k = j.k AND y.i = j.e LEFT JOIN {n}_small z ON z.k = j.k AND z.i = j.e + 1),
{paragraph_ctes(n + '_large', budget, n + '_para')},
{run_ctes(n + '_para', budget, 2, n + '_cut')},
{n}_b AS (SELECT k[1] AS doc_id, text, k[2] AS start_page, k[2] AS end_page, k[2] AS o1, 0 AS o2, s AS o3 FROM ({joined(n + '_para', n + '_cut')})),
{n} AS (SELECT * FROM {n}_a UNION ALL SELECT * FROM {n}_b)"""


PAGES_CHUNK_SQL = f"""{v.ctes('pages')}, {pages_ctes(PAGE_BUDGET)}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o1, o2, o3) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, CAST(start_page AS BIGINT) AS start_page, CAST(end_page AS BIGINT) AS end_page, CAST(length(text) // 4 AS BIGINT) AS token_count, md5(text) AS text_md5 FROM pk
"""


@query("chunk_pages", PAGES_CHUNK_SQL)
def chunk_pages(spark, sf):
    return chunk_digest(ch.by_pages(v.pages(spark, sf), PAGE_BUDGET))


PARAS_CHUNK_SQL = f"""{v.ctes('pages')}, src AS (SELECT row(doc_id, page_num) AS k, raw_text AS t FROM pages), {paragraph_ctes('src', PARA_BUDGET)}, {run_ctes('para', PARA_BUDGET, 0, 'cut')},
last AS (SELECT doc_id, max(page_num) AS last FROM pages GROUP BY doc_id),
c AS (SELECT k[1] AS doc_id, k[2] AS page_num, s, text, s = max(s) OVER (PARTITION BY k) AS rest FROM ({joined('para', 'cut')})),
d AS (SELECT c.* FROM c JOIN last l ON l.doc_id = c.doc_id WHERE NOT rest OR page_num = last OR length(text) // 4 >= 100)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, s) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, CAST(page_num AS BIGINT) AS start_page, CAST(page_num AS BIGINT) AS end_page, CAST(length(text) // 4 AS BIGINT) AS token_count, md5(text) AS text_md5 FROM d
"""


@query("chunk_paragraphs", PARAS_CHUNK_SQL)
def chunk_paragraphs(spark, sf):
    return chunk_digest(ch.by_paragraphs(v.pages(spark, sf), PARA_BUDGET))


@query("paragraph_split", f"""{v.ctes('pages')}, src AS (SELECT row(doc_id, page_num) AS k, raw_text AS t FROM pages), {paragraph_ctes('src', PARA_BUDGET)}
SELECT k[1] AS doc_id, CAST(k[2] AS BIGINT) AS page_num, i AS para_no, md5(t) AS text_md5 FROM para""")
def paragraph_split(spark, sf):
    p = v.pages(spark, sf).select("doc_id", F.col("page_num").cast("bigint").alias("page_num"), F.posexplode(ch.paragraphs(F.col("raw_text"), PARA_BUDGET)).alias("para_no", "t"))
    return p.select("doc_id", "page_num", F.col("para_no").cast("bigint").alias("para_no"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


@query("split_overlap", f"""{v.ctes('pages')}, src AS (SELECT row(doc_id, page_num) AS k, {strip('raw_text')} AS t FROM pages WHERE length({strip('raw_text')}) // 4 > {SPLIT_TARGET}), {paragraph_ctes('src', PARA_BUDGET)}, {run_ctes('para', SPLIT_TARGET, 2, 'cut')}
SELECT k[1] AS doc_id, CAST(k[2] AS BIGINT) AS page_num, row_number() OVER (PARTITION BY k ORDER BY s, e) - 1 AS piece, md5(text) AS text_md5 FROM ({joined('para', 'cut')})
UNION ALL SELECT doc_id, page_num, 0, md5({strip('raw_text')}) FROM pages WHERE length({strip('raw_text')}) // 4 <= {SPLIT_TARGET}""")
def split_overlap(spark, sf):
    p = v.pages(spark, sf).select("doc_id", F.col("page_num").cast("bigint").alias("page_num"), F.posexplode(ch.split_text(tx.strip(F.col("raw_text")), SPLIT_TARGET, PARA_BUDGET)).alias("piece", "t"))
    return p.select("doc_id", "page_num", F.col("piece").cast("bigint").alias("piece"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


TERMS = "|".join(ch.TERMINAL)
TRIM = strip(rf"regexp_replace(text, '\n\s*({TERMS})\s*\n.*$', chr(10), 'is')")
HEADS = "|".join(f"(?:{h})" for h in ch.SECTION_HEADS)
SECTION_CTES = rf"""sl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM src_text),
sh AS (SELECT *, regexp_matches({strip('line')}, '^(?:{HEADS})\s*$') AS head FROM sl), sg AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM sh),
sa AS (SELECT doc_id, grp, coalesce(max(CASE WHEN head THEN {strip('line')} END), 'Beginning') AS title, coalesce(max(CASE WHEN head THEN n END), 0) AS start_line, {strip("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT head), '')")} AS text FROM sg GROUP BY doc_id, grp),
secs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS sec_no, title, start_line, text FROM sa WHERE text <> '')"""


@query("full_text", f"{v.ctes('pages')} SELECT doc_id, md5(string_agg({strip('raw_text')}, chr(10) || chr(10) ORDER BY page_num)) AS text_md5 FROM pages WHERE {strip('raw_text')} <> '' GROUP BY doc_id")
def full_text(spark, sf):
    return ch.full_text(v.pages(spark, sf)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("trim_terminal", f"{v.ctes('papers')} SELECT doc_id, CAST(length({TRIM}) AS BIGINT) AS n_chars, md5({TRIM}) AS text_md5 FROM papers")
def trim_terminal(spark, sf):
    p = v.papers(spark, sf).select("doc_id", ch.trim_terminal(F.col("text")).alias("t"))
    return p.select("doc_id", F.length("t").cast("bigint").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


@query("section_boundaries", f"{v.ctes('papers')}, src_text AS (SELECT * FROM papers), {SECTION_CTES} SELECT doc_id, sec_no, title, CAST(start_line AS BIGINT) AS start_line, md5(text) AS text_md5 FROM secs")
def section_boundaries(spark, sf):
    return ch.section_boundaries(v.papers(spark, sf)).select("doc_id", F.col("sec_no").cast("bigint").alias("sec_no"), "title", F.col("start_line").cast("bigint").alias("start_line"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("chunk_entire", f"""{v.ctes('papers')}, whole AS (SELECT doc_id, {TRIM} AS text FROM papers), src_text AS (SELECT * FROM whole WHERE length(text) // 4 > {WHOLE_BUDGET}), {SECTION_CTES},
many AS (SELECT doc_id FROM secs GROUP BY doc_id HAVING count(*) > 1),
su AS (SELECT doc_id AS k, sec_no AS i, text AS t, title, length(text) AS len FROM secs WHERE doc_id IN (SELECT doc_id FROM many)), {run_ctes('su', WHOLE_BUDGET, 0, 'sr')},
src AS (SELECT doc_id AS k, text AS t FROM src_text WHERE doc_id NOT IN (SELECT doc_id FROM many)), {paragraph_ctes('src', PARA_BUDGET)}, {run_ctes('para', WHOLE_BUDGET, 1, 'cut')},
c AS (SELECT doc_id, 0 AS o, text, 'Entire Document' AS section FROM whole WHERE text <> '' AND length(text) // 4 <= {WHOLE_BUDGET}
  UNION ALL SELECT r.k, r.s, string_agg(u.t, chr(10) || chr(10) ORDER BY u.i), string_agg(u.title, ' + ' ORDER BY u.i) FROM sr r JOIN su u ON u.k = r.k AND u.i BETWEEN r.s AND r.e GROUP BY r.k, r.s, r.e
  UNION ALL SELECT k, s, text, 'Document Part ' || CAST(row_number() OVER (PARTITION BY k ORDER BY s, e) AS VARCHAR) FROM ({joined('para', 'cut')}))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, section, CAST(length(text) // 4 AS BIGINT) AS token_count, md5(text) AS text_md5 FROM c""")
def chunk_entire(spark, sf):
    d = v.papers(spark, sf).withColumn("page_count", F.lit(1))
    c = ch.entire(d, WHOLE_BUDGET, PARA_BUDGET)
    return c.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("total_chunks").cast("bigint").alias("total_chunks"), "section", F.col("token_count").cast("bigint").alias("token_count"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


SECT_SQL = """isl AS (SELECT *, sum(CASE WHEN level <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS grp FROM headings),
sections AS (SELECT doc_id, CAST(grp - 1 AS INT) AS sec_no, arg_min(text, ord) AS title, arg_min(page, ord) AS start_page, coalesce(arg_max(page, ord) FILTER (WHERE level > 2), arg_min(page, ord)) AS end_page FROM isl WHERE grp > 0 GROUP BY doc_id, grp)"""


@query("section_islands", f"{v.ctes('headings')}, {SECT_SQL} SELECT doc_id, CAST(sec_no AS BIGINT) AS sec_no, title, CAST(start_page AS BIGINT) AS start_page, CAST(end_page AS BIGINT) AS end_page FROM sections")
def section_islands(spark, sf):
    return structure.sections(v.headings(spark, sf)).select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("sec_no", "start_page", "end_page")], "title")


SECTION_TEXT = f"sp AS (SELECT s.doc_id, s.sec_no, s.title, s.start_page, s.end_page, string_agg({strip('p.raw_text')}, chr(10) || chr(10) ORDER BY p.page_num) AS t FROM sections s JOIN pages p ON p.doc_id = s.doc_id AND p.page_num BETWEEN s.start_page AND s.end_page WHERE {strip('p.raw_text')} <> '' GROUP BY ALL)"


@query("section_text_rangejoin", f"{v.ctes('pages', 'headings')}, {SECT_SQL}, {SECTION_TEXT} SELECT doc_id, CAST(sec_no AS BIGINT) AS sec_no, CAST(start_page AS BIGINT) AS start_page, CAST(end_page AS BIGINT) AS end_page, md5(t) AS text_md5 FROM sp")
def section_text_rangejoin(spark, sf):
    return ch.section_text(structure.sections(v.headings(spark, sf)), v.pages(spark, sf)).select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("sec_no", "start_page", "end_page")], F.md5(F.col("text").cast("binary")).alias("text_md5"))


def section_ctes(which: str = "TRUE") -> str:
    """CTE ``sc`` (doc_id, o, start_page, end_page, section, text): chunks of the sections' texts."""
    return f"""src AS (SELECT row(doc_id, sec_no) AS k, t FROM sp WHERE length(t) // 4 > {SPLIT_TARGET} AND {which}), {paragraph_ctes('src', PARA_BUDGET)}, {run_ctes('para', SPLIT_TARGET, 2, 'cut')},
sj AS (SELECT k[1] AS doc_id, k[2] AS sec_no, row_number() OVER (PARTITION BY k ORDER BY s, e) AS j, text FROM ({joined('para', 'cut')}) UNION ALL SELECT doc_id, sec_no, 0, t FROM sp WHERE length(t) // 4 <= {SPLIT_TARGET} AND {which}),
sc AS (SELECT sj.doc_id, row(sj.sec_no, j, 0) AS o, start_page, end_page, title AS section, text FROM sj JOIN sections s ON s.doc_id = sj.doc_id AND s.sec_no = sj.sec_no)"""


CHUNKED = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, CAST(start_page AS BIGINT) AS start_page, CAST(end_page AS BIGINT) AS end_page, section, CAST(length(text) // 4 AS BIGINT) AS token_count, md5(text) AS text_md5 FROM c"


@query("chunk_sections", f"""{v.ctes('pages', 'headings')}, {SECT_SQL}, {SECTION_TEXT}, {section_ctes()}, {pages_ctes(PARA_BUDGET, 'pk', 'doc_id NOT IN (SELECT doc_id FROM sections)')},
c AS (SELECT * FROM sc UNION ALL SELECT doc_id, row(o1, o2, o3), start_page, end_page, NULL, text FROM pk) {CHUNKED}""")
def chunk_sections(spark, sf):
    return chunk_digest(ch.by_sections(structure.sections(v.headings(spark, sf)), v.pages(spark, sf), SPLIT_TARGET, PARA_BUDGET), "section")


# the open chunk's text is carried from page to page; what a page closes comes out with it
SMART_SQL = rf"""rich AS (SELECT doc_id FROM sections GROUP BY doc_id HAVING count(*) >= 3), {section_ctes('doc_id IN (SELECT doc_id FROM rich)')},
hd AS (SELECT doc_id, page, arg_min(text, ord) AS head FROM headings WHERE level <= 2 GROUP BY doc_id, page),
up AS (SELECT p.doc_id AS k, row_number() OVER (PARTITION BY p.doc_id ORDER BY page_num) - 1 AS i, page_num, {strip('raw_text')} AS t, head FROM pages p LEFT JOIN hd ON hd.doc_id = p.doc_id AND hd.page = p.page_num WHERE {strip('raw_text')} <> '' AND p.doc_id NOT IN (SELECT doc_id FROM rich)),
st(k, i, text, a, b, sec, done, da, db, dsec) AS (
  SELECT k, i, t, page_num, page_num, head, CAST(NULL AS VARCHAR), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS VARCHAR) FROM up WHERE i = 0
  UNION ALL SELECT k, i, CASE WHEN headed THEN t WHEN over THEN tail || chr(10) || chr(10) || t ELSE pot END, CASE WHEN headed OR over THEN page_num ELSE a END, page_num, CASE WHEN headed THEN head ELSE coalesce(sec, head) END,
    CASE WHEN headed OR over THEN {strip('open')} END, CASE WHEN headed OR over THEN a END, CASE WHEN headed OR over THEN b END, CASE WHEN headed OR over THEN sec END
  FROM (SELECT u.k, u.i, u.t, u.page_num, u.head, s.text AS open, s.a, s.b, s.sec, s.text || chr(10) || chr(10) || u.t AS pot, u.head IS NOT NULL AS headed, u.head IS NULL AND length(s.text || chr(10) || chr(10) || u.t) // 4 > {PAGE_BUDGET} AS over,
    array_to_string(list_filter(string_split_regex(s.text, '\s+'), lambda w: w <> '')[-50:], ' ') AS tail FROM st s JOIN up u ON u.k = s.k AND u.i = s.i + 1)),
sm AS (SELECT k AS doc_id, row(i, 0, 0) AS o, da AS start_page, db AS end_page, dsec AS section, done AS text FROM st WHERE done IS NOT NULL
  UNION ALL SELECT k, row(i, 1, 0), a, b, sec, {strip('text')} FROM (SELECT *, max(i) OVER (PARTITION BY k) AS m FROM st) WHERE i = m)"""


@query("chunk_smart", f"{v.ctes('pages', 'headings')}, {SECT_SQL}, {SECTION_TEXT}, {SMART_SQL}, c AS (SELECT * FROM sc UNION ALL SELECT * FROM sm) {CHUNKED}")
def chunk_smart(spark, sf):
    h = v.headings(spark, sf)
    return chunk_digest(ch.smart(v.pages(spark, sf), h, structure.sections(h), PAGE_BUDGET, 200, SPLIT_TARGET, PARA_BUDGET), "section")


# ---- structure and profile -----------------------------------------------------------------------------------------


@query("heading_detect", rf"""{v.ctes('spans')}, l AS (SELECT doc_id, page_num, block_no, line_no, {strip("string_agg(" + strip('text') + ", ' ' ORDER BY span_no)")} AS text, max(size) AS font_size, bool_or(flags & 16 <> 0) AS is_bold FROM spans GROUP BY ALL),
h AS (SELECT * FROM l WHERE text <> '' AND length(text) < 200 AND NOT ends_with(text, '.') AND len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) < 20 AND (font_size > 14 OR is_bold))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, block_no, line_no) - 1 AS ord, text, CAST(page_num AS BIGINT) AS page, CAST(CASE WHEN font_size >= 18 THEN 1 WHEN font_size >= 16 THEN 2 WHEN font_size >= 14 OR is_bold THEN 3 ELSE 4 END AS BIGINT) AS level, font_size, is_bold FROM h""".replace("GROUP BY ALL", "GROUP BY doc_id, page_num, block_no, line_no"))
def heading_detect(spark, sf):
    return structure.headings(v.spans(spark, sf)).withColumns({c: F.col(c).cast("bigint") for c in ("ord", "page", "level")})


@query("chapter_filter", f"""{v.ctes('headings')} SELECT doc_id, ord, text AS title, page, level FROM headings WHERE level = 1 OR contains(lower(text), 'chapter') OR contains(lower(text), 'part') OR contains(lower(text), 'section') OR contains(lower(text), 'unit') OR regexp_matches(substr(text, 1, 10), '[0-9]')""")
def chapter_filter(spark, sf):
    return structure.chapters(v.headings(spark, sf))


@query("doc_text_hash", f"{v.ctes('pages')} SELECT doc_id, substr(sha256(string_agg(raw_text, '' ORDER BY page_num)), 1, 16) AS text_hash FROM pages WHERE page_num <= 5 GROUP BY doc_id")
def doc_text_hash(spark, sf):
    return structure.text_hash(v.pages(spark, sf))


def _re(p: str) -> str:
    return p.replace("'", "''")


PROFILE_SQL = rf"""{v.ctes('papers')}, pl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM papers),
pp AS (SELECT doc_id, CAST(n // 5 + 1 AS INT) AS page_num, string_agg(line, chr(10) || chr(10) ORDER BY n) AS t FROM pl GROUP BY doc_id, n // 5),
f AS (SELECT doc_id, max(page_num) AS page_count, bool_or(page_num = 1 AND regexp_matches(t, '{_re(profile.CHAPTER)}')) AS chapters_detected, bool_or(page_num = 1 AND regexp_matches(t, '{_re(profile.ABSTRACT)}')) AS abstract_present,
  coalesce(max(page_num) FILTER (WHERE regexp_matches(t, '{_re(profile.REFERENCES)}')) > max(page_num) - 5, FALSE) AS references_present, bool_or(page_num = 1 AND regexp_matches(t, '{_re(profile.DOI)}')) AS has_doi, doc_id % 6 = 0 AS toc_present FROM pp GROUP BY doc_id),
g AS (SELECT *, CASE WHEN 2 * abstract_present::INT + 2 * references_present::INT + 3 * has_doi::INT + (page_count BETWEEN 5 AND 30)::INT >= 4 THEN 'research_paper' WHEN 3 * chapters_detected::INT + 2 * toc_present::INT + 2 * (page_count > 50)::INT >= 4 THEN 'textbook' ELSE 'unknown' END AS doc_type FROM f)"""


def _profiles(spark, sf):
    return profile.features(v.paged(v.papers(spark, sf)), v.table(spark, sf, "documents").where("doc_id % 6 = 0").select("doc_id"))


@query("doc_profile_classify", PROFILE_SQL + " SELECT doc_id, CAST(page_count AS BIGINT) AS page_count, chapters_detected, abstract_present, references_present, has_doi, toc_present, doc_type FROM g")
def doc_profile_classify(spark, sf):
    return _profiles(spark, sf).drop("two_column_layout").withColumn("page_count", F.col("page_count").cast("bigint"))


@query("heuristic_defaults", PROFILE_SQL + """ SELECT doc_id, CASE doc_type WHEN 'research_paper' THEN 'sections' WHEN 'textbook' THEN 'smart' ELSE 'pages' END AS mode,
CAST(CASE WHEN page_count > 100 THEN greatest(CASE doc_type WHEN 'research_paper' THEN 1500 WHEN 'textbook' THEN 2500 ELSE 2000 END, 3000) ELSE CASE doc_type WHEN 'research_paper' THEN 1500 WHEN 'textbook' THEN 2500 ELSE 2000 END END AS BIGINT) AS tokens_per_chunk,
CASE doc_type WHEN 'research_paper' THEN 'key_points,cloze_definitions' WHEN 'textbook' THEN 'key_points,figure_based' ELSE 'key_points' END AS strategies FROM g""")
def heuristic_defaults(spark, sf):
    return profile.defaults(_profiles(spark, sf)).select("doc_id", "mode", F.col("tokens_per_chunk").cast("bigint").alias("tokens_per_chunk"), F.array_join("strategies", ",").alias("strategies"))


# ---- cards ---------------------------------------------------------------------------------------------------------


def cards(spark, sf):
    return v.cards(spark, sf)


def tagged(spark, sf):
    return v.cards(spark, sf).withColumn("tags", cd.tag_list(F.col("tags")))


C = v.ctes("cards")


@query("cloze_format", rf"{C} SELECT card_ord, CAST(len(regexp_extract_all(cloze_text, '{CLOZE_RE}')) AS BIGINT) AS n_cloze, len(regexp_extract_all(cloze_text, '{CLOZE_RE}')) BETWEEN 1 AND 3 AS ok FROM cards")
def cloze_format(spark, sf):
    return cards(spark, sf).select("card_ord", cd.cloze_count(F.col("cloze_text")).cast("bigint").alias("n_cloze"), cd.cloze_ok(F.col("cloze_text")).alias("ok"))


JSON_SQL = """resp AS (SELECT doc_id, 0 AS chunk_index, CAST(1 + doc_id % 9 AS INT) AS start_page, CASE WHEN doc_id % 3 = 0 THEN 'cloze_definitions' ELSE 'key_points' END AS strategy,
  CASE WHEN doc_id % 17 = 0 THEN 'not json' WHEN doc_id % 19 = 0 THEN '[1,2]' WHEN doc_id % 23 = 0 THEN '{"other": 1}'
  WHEN doc_id % 29 = 0 THEN '{"cards": [{"front": 5, "back": "x"}]}'
  WHEN doc_id % 3 = 0 THEN '{"cards": [{"cloze_text": "{{c1::a' || CAST(doc_id AS VARCHAR(20)) || '}} b", "tags": "P;q"}, {"cloze_text": "{{c1::a}} {{c2::b}}", "difficulty": "easy"}]}'
  ELSE '{"cards": [{"front": " f' || CAST(doc_id AS VARCHAR(20)) || ' ", "back": "b", "difficulty": "odd", "tags": ["X", " y "]}, {"front": "g", "back": "h", "page_citation": "p. 3"}]}' END AS content FROM documents)"""


@query("json_cards_parse", "WITH " + JSON_SQL + r""", good AS (SELECT * FROM resp WHERE json_valid(content) AND json_type(content) = 'OBJECT' AND json_type(content, '$.cards') = 'ARRAY'),
e AS (SELECT doc_id, start_page, strategy, unnest(CAST(json_extract(content, '$.cards') AS JSON[])) AS c, unnest(range(CAST(json_array_length(content, '$.cards') AS BIGINT))) AS n FROM good),
k AS (SELECT *, CASE WHEN strategy = 'cloze_definitions' THEN json_type(c, '$.cloze_text') = 'VARCHAR' ELSE json_type(c, '$.front') = 'VARCHAR' AND json_type(c, '$.back') = 'VARCHAR' END AS ok FROM e),
g AS (SELECT doc_id FROM k GROUP BY doc_id HAVING bool_and(coalesce(ok, FALSE)))
SELECT doc_id, CAST(n AS BIGINT) AS card_no, CASE WHEN strategy = 'key_points' THEN 'Basic' ELSE 'Cloze' END AS note_type, coalesce(c->>'$.page_citation', 'p. ' || CAST(start_page AS VARCHAR)) AS page_citation,
CASE WHEN (c->>'$.difficulty') IN ('easy', 'medium', 'hard') THEN (c->>'$.difficulty') ELSE 'medium' END AS difficulty, trim(coalesce(c->>'$.front', '')) AS front, trim(coalesce(c->>'$.back', '')) AS back, trim(coalesce(c->>'$.cloze_text', '')) AS cloze_text,
CASE WHEN strategy = 'key_points' THEN CASE WHEN (c->'$.tags') IS NULL THEN 'key-points' ELSE 'key-points,x,y' END ELSE CASE WHEN (c->'$.tags') IS NULL THEN 'cloze-definitions' ELSE 'cloze-definitions,p,q' END END AS tags FROM k WHERE doc_id IN (SELECT doc_id FROM g)""")
def json_cards_parse(spark, sf):
    r = spark.sql("WITH " + v._named(JSON_SQL, {"documents": 0}) + " SELECT * FROM resp", documents=v.table(spark, sf, "documents"))
    c = cd.parse_responses(r)
    return c.select("doc_id", F.col("card_no").cast("bigint").alias("card_no"), "note_type", "page_citation", "difficulty", "front", "back", "cloze_text", F.array_join("tags", ",").alias("tags"))


@query("tag_normalize", f"""{C}, t AS (SELECT card_ord, strategy, unnest(string_split(tags, ';')) AS t, unnest(range(len(string_split(tags, ';')))) AS i FROM cards),
u AS (SELECT card_ord, CASE WHEN strategy = 'key_points' THEN 'key-points' ELSE 'cloze-definitions' END AS t, -1 AS i FROM cards UNION ALL SELECT card_ord, lower({strip('t')}), i FROM t WHERE {strip('t')} <> ''),
d AS (SELECT card_ord, t, min(i) AS i FROM u GROUP BY card_ord, t) SELECT card_ord, string_agg(t, ',' ORDER BY i) AS tags FROM d GROUP BY card_ord""")
def tag_normalize(spark, sf):
    own = F.when(F.col("strategy") == "key_points", "key-points").otherwise("cloze-definitions")
    return tagged(spark, sf).select("card_ord", F.array_join(cd.normal_tags(F.col("tags"), own), ",").alias("tags"))


@query("mock_generation", f"""{v.ctes('pages')}, c AS (SELECT doc_id, page_num, list_filter(string_split(raw_text, chr(10)), lambda x: {strip('x')} <> '')[1:2] AS l FROM pages),
e AS (SELECT doc_id, page_num, unnest(l) AS x, unnest(range(len(l))) AS n FROM c) SELECT doc_id, CAST(page_num AS BIGINT) AS page_num, CAST(n AS BIGINT) AS card_no, {strip("'What about ' || substr(x, 1, 20) || '?'")} AS front, {strip('x')} AS back FROM e
WHERE (doc_id, page_num) NOT IN (SELECT doc_id, page_num FROM e WHERE {strip('x')} = '')""")
def mock_generation(spark, sf):
    p = v.pages(spark, sf).select("doc_id", F.col("page_num").alias("chunk_index"), F.col("page_num").alias("start_page"), F.col("raw_text").alias("text"))
    c = cd.parse_responses(cd.mock_responses(p))
    return c.select("doc_id", F.col("chunk_index").cast("bigint").alias("page_num"), F.col("card_no").cast("bigint").alias("card_no"), "front", "back")


@query("card_provenance", f"""{v.ctes('pages', 'cards')} SELECT card_ord, c.front, CASE WHEN length(raw_text) > 500 THEN substr(raw_text, 1, 500) || '...' ELSE raw_text END AS original_text, 'p. ' || CAST(page_num AS VARCHAR) AS ref_citation, 'f' || CAST(p.doc_id % 7 AS VARCHAR) || '.pdf' AS source_pdf
FROM cards c JOIN pages p ON p.doc_id = c.card_ord AND p.page_num = 1""")
def card_provenance(spark, sf):
    p = v.pages(spark, sf).select("doc_id", F.col("page_num").alias("chunk_index"), F.col("page_num").alias("start_page"), F.col("page_num").alias("end_page"), F.lit(None).cast("string").alias("section"), F.concat(F.lit("f"), (F.col("doc_id") % 7).cast("string"), F.lit(".pdf")).alias("source_pdf"), F.col("raw_text").alias("text"))
    c = cards(spark, sf).select("card_ord", "front", F.col("card_ord").alias("doc_id"), F.lit(1).alias("chunk_index"))
    return cd.with_provenance(c, p, "mock").select("card_ord", "front", "original_text", "ref_citation", "source_pdf")


# every third quote is taken from the chunk itself, the others from elsewhere
QUOTED = """SELECT doc_id AS card_ord, doc_id, 1 AS chunk_index, 'It says "' || CASE WHEN doc_id % 3 = 0 THEN substr(text, 3, 25) WHEN doc_id % 3 = 1 THEN 'short one' ELSE 'certainly not in there' END || '" and more' AS front, 'b' AS back, '' AS cloze_text, '' AS extra,
  CASE WHEN doc_id % 12 = 0 THEN ' ' ELSE 'p. 1' END AS page_citation, 'p. 1' AS ref_citation FROM documents"""


@query("quote_verification", rf"""WITH cards AS ({QUOTED}), q AS (SELECT card_ord, unnest(regexp_extract_all(front || ' ' || back || ' ' || cloze_text || ' ' || extra || ' ', '"([^"]*)"', 1)) AS q FROM cards),
bad AS (SELECT DISTINCT card_ord FROM q JOIN documents d ON d.doc_id = q.card_ord WHERE length(q) > 10 AND NOT contains(lower(d.text), lower(q)))
SELECT card_ord, trim(page_citation) <> '' AND trim(ref_citation) <> '' AND card_ord NOT IN (SELECT card_ord FROM bad) AS valid FROM cards""")
def quote_verification(spark, sf):
    d = v.table(spark, sf, "documents")
    c = v._sql(spark, QUOTED, documents=d)
    return cd.verified(c, d.select("doc_id", F.lit(1).alias("chunk_index"), "text"), drop=False).select("card_ord", "valid")


@query("figure_chunk_semijoin", f"""{v.ctes('papers')}, im AS (SELECT doc_id, 1 + doc_id % 2 AS p FROM documents WHERE doc_id % 3 = 0), t AS (SELECT doc_id, lower(text) AS x FROM papers),
w AS (SELECT *, list_bool_or([contains(x, w) FOR w IN ['figure', 'fig.', 'table', 'chart', 'graph', 'diagram', 'image', 'picture', 'plot', 'illustration', 'exhibit']]) AS any_word, list_bool_or([contains(x, w) FOR w IN ['figure', 'table', 'chart', 'graph']]) AS named FROM t)
SELECT doc_id FROM w WHERE any_word AND (named OR doc_id IN (SELECT doc_id FROM im WHERE p = 1))""")
def figure_chunk_semijoin(spark, sf):
    p = v.papers(spark, sf).withColumns({"start_page": F.lit(1), "end_page": F.lit(1)})
    i = v.table(spark, sf, "documents").where("doc_id % 3 = 0").select("doc_id", (1 + F.col("doc_id") % 2).alias("page_num"))
    return cd.figure_chunks(p, i).select("doc_id")


REVIEWS = """SELECT doc_id AS card_ord, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(doc_id % 10 AS DOUBLE) + 0.5 END AS score, CASE WHEN doc_id % 4 = 0 THEN 'edited ' || CAST(doc_id AS VARCHAR(20)) WHEN doc_id % 4 = 1 THEN '' ELSE NULL END AS edit_front, CASE WHEN doc_id % 6 = 0 THEN ' back ' ELSE NULL END AS edit_back FROM documents WHERE doc_id % 7 <> 0"""


@query("review_apply", f"""{C}, r AS (SELECT card_ord, coalesce(score, 5.0) AS s, edit_front AS ef, edit_back AS eb FROM ({REVIEWS}))
SELECT c.card_ord, coalesce(ef, front) AS front, coalesce(eb, back) AS back, CASE WHEN note_type = 'Cloze' AND ef IS NOT NULL THEN ef ELSE cloze_text END AS cloze_text, coalesce(s, -1.0) AS score, ef IS NOT NULL OR eb IS NOT NULL AS edited
FROM cards c LEFT JOIN r ON r.card_ord = c.card_ord WHERE s IS NULL OR s >= 7""")
def review_apply(spark, sf):
    r = v._sql(spark, REVIEWS, documents=v.table(spark, sf, "documents")).withColumn("issues", F.array(F.lit("none")))
    return cd.reviewed(cards(spark, sf), r).select("card_ord", "front", "back", "cloze_text", F.coalesce("review_score", F.lit(-1.0)).alias("score"), F.col("review_edited").alias("edited"))


@query("review_metrics", f"""WITH r AS (SELECT coalesce(score, 5.0) >= 7 AS kept, coalesce(edit_front <> '', FALSE) AS e FROM ({REVIEWS})), m AS (SELECT count(*) AS reviewed, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS dropped, count(*) FILTER (WHERE kept AND e) AS edited FROM r)
SELECT *, round_even(dropped / greatest(reviewed, 1), 3) AS drop_rate, round_even(edited / greatest(reviewed, 1), 3) AS edit_rate FROM m""")
def review_metrics(spark, sf):
    r = v._sql(spark, REVIEWS, documents=v.table(spark, sf, "documents"))
    return telemetry.review_metrics(r.select("score", F.coalesce(F.col("edit_front") != "", F.lit(False)).alias("edited")))


RESPONSES = """SELECT doc_id AS card_ord, 'card' || CAST(doc_id AS VARCHAR(20)) AS id, CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'no json' WHEN 2 THEN '[7]' WHEN 3 THEN '{"issues": ["no score"]}' WHEN 4 THEN '{"score": "8.5"}'
  WHEN 5 THEN '{"score": "high"}' WHEN 6 THEN '{"id": "other", "score": 6, "issues": ["vague", "long"], "edited": {"front": " better ' || CAST(doc_id AS VARCHAR(20)) || ' "}}' ELSE '{"score": 9.25, "issues": [], "edited": null}' END AS content FROM documents"""


@query("review_parse", f"""WITH r AS ({RESPONSES}), v AS (SELECT *, CASE WHEN json_valid(content) AND json_type(content) = 'OBJECT' THEN content END AS j FROM r), s AS (SELECT *, TRY_CAST(j->>'$.score' AS DOUBLE) AS s FROM v)
SELECT card_ord, CASE WHEN s IS NULL THEN id ELSE coalesce(j->>'$.id', id) END AS id, coalesce(s, 5.0) AS score, CASE WHEN s IS NULL THEN 'no usable review' ELSE coalesce(array_to_string(CAST(j->'$.issues' AS VARCHAR[]), ','), '') END AS issues, CASE WHEN s IS NOT NULL THEN j->>'$.edited.front' END AS edit_front FROM s""")
def review_parse(spark, sf):
    r = generation.parse_reviews(v._sql(spark, RESPONSES, documents=v.table(spark, sf, "documents")))
    return r.select("card_ord", "id", "score", F.array_join("issues", ",").alias("issues"), "edit_front")


@query("truncate_text", """SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...[truncated]' ELSE text END AS head, CASE WHEN length(text) > 400 THEN '[truncated]...' || right(text, 400) ELSE text END AS tail, CASE WHEN length(text) > 400 THEN substr(text, 1, 200) || '...[middle truncated]...' || right(text, 200) ELSE text END AS both FROM documents""")
def truncate_text(spark, sf):
    t = F.col("text")
    return v.table(spark, sf, "documents").select("doc_id", tx.truncate_tokens(t, 100).alias("head"), tx.truncate_tokens(t, 100, "start").alias("tail"), tx.truncate_tokens(t, 100, "middle").alias("both"))


@query("text_filters", rf"""SELECT doc_id, md5(replace({collapse('text')}, '"', '''')) AS clean_md5, CASE WHEN len(string_split({collapse('text')}, ' ')) > 30 THEN array_to_string(string_split({collapse('text')}, ' ')[1:30], ' ') || '...' ELSE text END AS first_words FROM documents""")
def text_filters(spark, sf):
    t = F.col("text")
    return v.table(spark, sf, "documents").select("doc_id", F.md5(tx.clean_text(t).cast("binary")).alias("clean_md5"), tx.truncate_words(t, 30).alias("first_words"))


@query("generation_plan", f"{v.ctes('pages')}, f AS (SELECT doc_id, string_agg({strip('raw_text')}, chr(10) || chr(10) ORDER BY page_num) AS t FROM pages WHERE page_num <= 3 AND {strip('raw_text')} <> '' GROUP BY doc_id) SELECT doc_id, CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '...' ELSE t END AS preview FROM f")
def generation_plan(spark, sf):
    first = ch.by_pages(v.pages(spark, sf).where("page_num <= 3"), 10**6).where("chunk_index = 0")
    return first.select("doc_id", tx.preview(F.col("text"), 200).alias("preview"))


# ---- identity and duplicates ---------------------------------------------------------------------------------------

CMP = f"CASE note_type WHEN 'Basic' THEN front || ' | ' || back WHEN 'Cloze' THEN {uncloze('cloze_text')} || ' | ' || coalesce(extra, '') ELSE front || ' | ' || back || ' | ' || cloze_text || ' | ' || coalesce(extra, '') END"
NORMAL = "CASE note_type WHEN 'Basic' THEN front || '||' || back WHEN 'Cloze' THEN cloze_text || '||' || coalesce(extra, '') ELSE front || '||' || back || '||' || cloze_text || '||' || coalesce(extra, '') END"
KEY = f"concat_ws('|', 'salt', note_type, lower({collapse(NORMAL)}), source_pdf, CAST(page_start AS VARCHAR) || '-' || coalesce(CAST(page_end AS VARCHAR), ''))"


@query("content_key_md5", f"{C} SELECT card_ord, md5({KEY}) AS key_md5 FROM cards")
def content_key_md5(spark, sf):
    return cards(spark, sf).select("card_ord", F.md5(identity.content_key("salt").cast("binary")).alias("key_md5"))


@query("content_hash_blake2b")
def content_hash_blake2b(spark, sf):
    return identity.content_ids(cards(spark, sf), "salt").select("card_ord", "id")


PKEY = "concat_ws('|', source_pdf, CAST(page_start AS VARCHAR), core_concept, note_type, strategy)"


@query("persistent_ids", f"""{C}, k AS (SELECT *, {PKEY} AS key FROM cards), old AS (SELECT key, 'salt_' || lpad(CAST(max(card_ord) + 1 AS VARCHAR), 6, '0') AS id FROM k WHERE note_type = 'Cloze' GROUP BY key),
mx AS (SELECT max(CAST(substr(id, 6) AS INT)) AS m FROM old), n AS (SELECT key, min(card_ord) AS f FROM k WHERE key NOT IN (SELECT key FROM old) GROUP BY key),
new AS (SELECT key, 'salt_' || lpad(CAST(m + row_number() OVER (ORDER BY f) AS VARCHAR), 6, '0') AS id FROM n, mx) SELECT card_ord, coalesce(old.id, new.id) AS id FROM k LEFT JOIN old ON old.key = k.key LEFT JOIN new ON new.key = k.key""")
def persistent_ids(spark, sf):
    c = cards(spark, sf)
    old = identity.known_ids(c.where("note_type = 'Cloze'").withColumn("id", F.format_string("salt_%06d", F.col("card_ord") + 1)))
    return identity.persistent_ids(c.drop("id"), old, "salt").select("card_ord", "id")


@query("dedup_exact_hash", f"{C}, h AS (SELECT card_ord, md5({collapse('lower(' + CMP + ')')}) AS h FROM cards) SELECT min(card_ord) AS card_ord, h AS content_hash FROM h GROUP BY h")
def dedup_exact_hash(spark, sf):
    c = cards(spark, sf).withColumn("content_hash", dedup.content_hash(dedup.comparison_text()))
    return dedup.first_of(c, F.col("content_hash")).select("card_ord", "content_hash")


@query("dedup_front", f"""{C}, k AS (SELECT card_ord, source_pdf, CASE WHEN lower({strip('front')}) <> '' THEN 'f:' || lower({strip('front')}) WHEN lower({strip(uncloze('cloze_text'))}) <> '' THEN 'c:' || lower({strip(uncloze('cloze_text'))}) ELSE 'w:' || {CMP} END AS k FROM cards) SELECT min(card_ord) AS card_ord FROM k GROUP BY source_pdf, k""")
def dedup_front(spark, sf):
    return dedup.by_front(cards(spark, sf), ["source_pdf"]).select("card_ord")


@query("dedup_cloze", f"{C} SELECT min(card_ord) AS card_ord FROM cards WHERE {strip('cloze_text')} <> '' GROUP BY {collapse('lower(' + uncloze('cloze_text') + ')')}")
def dedup_cloze(spark, sf):
    return dedup.by_cloze(cards(spark, sf)).select("card_ord")


@query("dedup_persistent_antijoin", f"{C}, h AS (SELECT card_ord, difficulty, md5({collapse('lower(' + CMP + ')')}) AS h FROM cards) SELECT min(card_ord) AS card_ord FROM h WHERE h NOT IN (SELECT h FROM h WHERE difficulty = 'vague') GROUP BY h")
def dedup_persistent_antijoin(spark, sf):
    c = cards(spark, sf)
    old = c.where("difficulty = 'vague'").select(dedup.content_hash(dedup.comparison_text()).alias("content_hash"))
    return dedup.against_index(c, old)[0].select("card_ord")


@query("dedup_fuzzy")
def dedup_fuzzy(spark, sf):
    """Too many long pairs for SQL (``dedup_fuzzy_prompts`` has it); tested against a sequential pass on small tables."""
    return dedup.within_run(cards(spark, sf)).select("card_ord")


#: Bits of a word in the SQL for common subsequences; one more holds the carry.
WORD = 120
ONES = f"(({2**WORD - 1})::HUGEINT)"


def near_ctes(cards: str, least: float = 0.85) -> str:
    """CTEs ``first`` (i, t: the first card of each comparison text) and ``pairs`` (i, j, ratio) of those that reach ``least``.

    Lengths and counts of characters (by code modulo 64) bound the ratio from above. What they let pass is measured bit by bit: for each
    character of one text, words of bits that stand for the places of the other are added up, with the carry from word to word;
    the places without a bit at the end are the common subsequence."""
    added = "(z[1] + (z[1] & coalesce(z[2], 0::HUGEINT)) + acc[-1])"
    word = f"list_append(list_append(acc[:-2], ({added} & {ONES}) | (z[1] & xor(coalesce(z[2], 0::HUGEINT), {ONES}))), {added} >> {WORD})"
    step = f"list_reduce(list_zip(v, masks[c]), lambda acc, z: {word}, [0::HUGEINT])[:-2]"
    full = f"list_transform(range((n + {WORD - 1}) // {WORD}), lambda x: {ONES})"
    free = f"list_reduce(string_split(other, ''), lambda v, c: {step}, {full})"
    return f"""first AS MATERIALIZED (SELECT min(card_ord) AS i, {CMP} AS t, length({CMP}) AS n FROM {cards} GROUP BY ALL),
chars AS (SELECT i, unnest(string_split(t, '')) AS c, unnest(range(n)) AS p FROM first),
counts AS (SELECT i, list(q ORDER BY k) AS h FROM (SELECT f.i, k, count(c) AS q FROM first f CROSS JOIN (SELECT unnest(range(64)) AS k) s LEFT JOIN chars c ON c.i = f.i AND unicode(c.c) % 64 = k GROUP BY f.i, k) GROUP BY i),
bound AS MATERIALIZED (SELECT x.i, y.i AS j, x.n + y.n AS total FROM (SELECT * FROM first JOIN counts USING (i)) x JOIN (SELECT * FROM first JOIN counts USING (i)) y ON x.i < y.i AND 2 * least(x.n, y.n) >= {least} * (x.n + y.n)
  WHERE 2 * list_sum(list_transform(list_zip(x.h, y.h), lambda z: least(z[1], z[2]))) >= {least} * (x.n + y.n)),
words AS (SELECT i, c, p // {WORD} AS w, sum(1::HUGEINT << CAST(p % {WORD} AS INT)) AS bits FROM chars GROUP BY ALL),
masks AS MATERIALIZED (SELECT i, map_from_entries(list(row(c, m))) AS masks FROM (SELECT i, c, list(coalesce(bits, 0::HUGEINT) ORDER BY w) AS m FROM
  (SELECT a.i, a.c, s.w, b.bits FROM (SELECT DISTINCT i, c FROM words) a JOIN (SELECT i, unnest(range((n + {WORD - 1}) // {WORD})) AS w FROM first) s ON s.i = a.i LEFT JOIN words b ON b.i = a.i AND b.c = a.c AND b.w = s.w) GROUP BY i, c) GROUP BY i),
pairs AS MATERIALIZED (SELECT i, j, ratio FROM (SELECT i, j, 2.0 * ({WORD} * len(v) - list_sum(list_transform(v, lambda x: bit_count(x)))) / total AS ratio FROM
  (SELECT i, j, total, {free} AS v FROM (SELECT b.i, b.j, b.total, x.n, y.t AS other, m.masks FROM bound b JOIN first x ON x.i = b.i JOIN first y ON y.i = b.j JOIN masks m ON m.i = b.i))) WHERE ratio >= {least})"""


T, P = v.ctes("turn_cards"), v.ctes("turn_cards", "prompts")


@query("turn_cards", f"{T} SELECT card_ord, source_pdf, page_start, page_end, md5({CMP}) AS text_md5 FROM turn_cards")
def turn_cards(spark, sf):
    return v.turn_cards(spark, sf).select("card_ord", "source_pdf", "page_start", "page_end", F.md5(dedup.comparison_text().cast("binary")).alias("text_md5"))


@query("near_prompts", f"{P}, {near_ctes('prompts')} SELECT i, j, round(ratio, 6) AS ratio FROM pairs")
def near_prompts(spark, sf):
    c = dedup.first_of(v.prompts(spark, sf).withColumn("text", dedup.comparison_text()), F.col("text")).select("card_ord", "text")
    side = lambda k: c.select(F.col("card_ord").alias(k), F.col("text").alias(f"_{k}"))
    return dedup.near_texts(c).join(side("i"), "i").join(side("j"), "j").select("i", "j", F.round(indel(F.col("_i"), F.col("_j")), 6).alias("ratio"))


@query("dedup_fuzzy_prompts", f"""{P}, {near_ctes('prompts')}, o AS MATERIALIZED (SELECT i, row_number() OVER (ORDER BY i) AS k FROM first), near AS MATERIALIZED (SELECT j, list(i) AS earlier FROM pairs GROUP BY j),
greedy(k, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT o.k, CASE WHEN list_has_any(coalesce(near.earlier, []), kept) THEN kept ELSE list_append(kept, o.i) END FROM greedy g JOIN o ON o.k = g.k + 1 LEFT JOIN near ON near.j = o.i)
SELECT unnest(kept) AS card_ord FROM (SELECT kept FROM greedy ORDER BY k DESC LIMIT 1)""")
def dedup_fuzzy_prompts(spark, sf):
    """Each prompt in order against those kept before it."""
    return dedup.within_run(v.prompts(spark, sf)).select("card_ord")


# ---- retrieval -----------------------------------------------------------------------------------------------------

UNIT = "nrm AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / n) AS e FROM nrm)"
TOP = f"WITH {UNIT}, s AS (SELECT q.vec_id AS query_id, i.vec_id, round(list_dot_product(q.e, i.e), 6) AS score, list_dot_product(q.e, i.e) AS full_score FROM u q, u i WHERE q.vec_id % 50 = 0), r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(full_score, 9) DESC, vec_id) AS rank FROM s)"


def hits(spark, sf, k):
    e = v.table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.top_k(q, e, k)


@query("rag_topk_cosine", f"{TOP} SELECT query_id, vec_id, score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5")
def rag_topk_cosine(spark, sf):
    return hits(spark, sf, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("rag_context", f"""{TOP}, t AS (SELECT doc_id, text, 1 + doc_id % 9 AS p FROM documents),
c AS (SELECT query_id, string_agg('[Context from p.' || CAST(p AS VARCHAR) || '-' || CAST(p + 1 AS VARCHAR) || ']: ' || substr(text, 1, 200) || '...', chr(10) || chr(10) ORDER BY rank) AS x FROM r JOIN t ON t.doc_id = r.vec_id WHERE rank <= 3 AND score > 0.2 GROUP BY query_id)
SELECT t.doc_id AS chunk_id, md5(text || coalesce(chr(10) || chr(10) || '--- Additional Context ---' || chr(10) || x, '')) AS text_md5 FROM t LEFT JOIN c ON c.query_id = t.doc_id""")
def rag_context(spark, sf):
    p = (1 + F.col("doc_id") % 9).cast("int")
    c = v.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", p.alias("start_page"), (p + 1).alias("end_page"))
    return retrieval.with_context(c, hits(spark, sf, 3), 3, 0.2).select("chunk_id", F.md5(F.col("context_text").cast("binary")).alias("text_md5"))


@query("rag_stats", "SELECT count(*) AS vectors, CAST(max(len(embedding)) AS BIGINT) AS dimensions, CAST(5 AS BIGINT) AS k FROM embeddings")
def rag_stats(spark, sf):
    return retrieval.index_stats(v.table(spark, sf, "embeddings")).withColumns({c: F.col(c).cast("bigint") for c in ("dimensions", "k")})


@query("dedup_embedding_pairs", f"WITH {UNIT} SELECT a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.e, b.e), 6) AS similarity FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE round(list_dot_product(a.e, b.e), 6) >= 0.5")
def dedup_embedding_pairs(spark, sf):
    return retrieval.similar_pairs(v.table(spark, sf, "embeddings"), 0.5)


# ---- validation, decks, telemetry, registry ------------------------------------------------------------------------


def _rule(severity: str, rule: str, field: str, kind: str, where: str) -> str:
    return f"SELECT '{severity}' AS severity, '{rule}' AS rule, '{field}' AS field, '{kind}' AS note_type, count(*) AS n FROM cards WHERE {where}"


def _blank(c: str) -> str:
    return f"coalesce({strip(c)} = '', TRUE)"


VALIDATE_SQL = f"{C}, i AS (" + " UNION ALL ".join([
    _rule("error", "empty_id", "id", "", _blank("id")), _rule("warning", "id_length", "id", "", f"id <> '' AND NOT length({strip('id')}) BETWEEN 4 AND 100"),
    *[f"SELECT 'warning', 'empty_column', '{c}', '', CAST(count(*) > 0 AND count({c}) = 0 AS BIGINT) FROM cards" for c in ("id", "deck", "note_type", "tags", "media")],
    *[_rule("warning", "page_not_numeric", c, "", f"trim(CAST({c} AS VARCHAR)) <> '' AND TRY_CAST({c} AS DOUBLE) IS NULL") for c in ("page_start", "page_end")],
    _rule("error", "missing_note_type", "note_type", "", "note_type IS NULL"),
    _rule("warning", "unknown_note_type", "note_type", "", "note_type NOT IN ('Basic', 'Cloze')"),
    *[_rule("error", "empty_field", f, t, f"note_type = '{t}' AND {_blank(f)}") for t, f in (("Basic", "front"), ("Basic", "back"), ("Cloze", "cloze_text"))],
    _rule("error", "no_cloze", "cloze_text", "Cloze", f"note_type = 'Cloze' AND NOT {_blank('cloze_text')} AND len(regexp_extract_all(cloze_text, '{CLOZE_RE}')) = 0"),
    _rule("warning", "many_cloze", "cloze_text", "Cloze", f"note_type = 'Cloze' AND len(regexp_extract_all(cloze_text, '{CLOZE_RE}')) > 5"),
    *[_rule("warning", "long_content", f, "", f"length({f}) > 10000") for f in ("front", "back", "cloze_text", "extra")],
    *[_rule("warning", "short_content", f, "", f"length({f}) < 5 AND {f} <> ''") for f in ("front", "back", "cloze_text")],
    "SELECT 'error', 'duplicate_id', 'id', '', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM cards GROUP BY id)",
    f"SELECT 'warning', 'missing_media', 'media', '', count(*) FROM (SELECT DISTINCT {strip('x')} AS x FROM (SELECT unnest(string_split(media, ';')) AS x FROM cards)) WHERE x <> '' AND x NOT IN ('a0.png', 'b.png')",
]) + ") SELECT * FROM i WHERE n > 0"


@query("validate_report", VALIDATE_SQL)
def validate_report(spark, sf):
    return validate.issues(cards(spark, sf), spark.createDataFrame([("a0.png",), ("b.png",)], "name string"))


@query("duplicate_ids", f"{C} SELECT coalesce(id, '(none)') AS id, CAST(count(*) - 1 AS BIGINT) AS extra FROM cards GROUP BY cards.id HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return validate.duplicate_ids(cards(spark, sf)).withColumn("id", F.coalesce("id", F.lit("(none)")))


@query("card_stats", C + " " + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value, count(*) AS n FROM cards WHERE {f} IS NOT NULL GROUP BY {f}" for f in ("note_type", "strategy", "difficulty")))
def card_stats(spark, sf):
    return validate.statistics(cards(spark, sf))


@query("metadata_completeness", C + " " + " UNION ALL ".join(f"SELECT '{f}' AS field, round(avg(CASE WHEN {_blank('CAST(' + f + ' AS VARCHAR)')} THEN 0.0 ELSE 1.0 END) * 100, 6) AS percent FROM cards" for f in ("source_pdf", "page_start", "page_end", "section", "ref_citation", "strategy", "core_concept")))
def metadata_completeness(spark, sf):
    return validate.completeness(cards(spark, sf)).withColumn("percent", F.round("percent", 6))


@query("media_antijoin", f"{C}, m AS (SELECT DISTINCT {strip('x')} AS name FROM (SELECT unnest(string_split(media, ';')) AS x FROM cards)) SELECT name FROM m WHERE name NOT IN ('', 'a0.png')")
def media_antijoin(spark, sf):
    return validate.missing_media(cards(spark, sf), spark.createDataFrame([("a0.png",)], "name string"))


@query("validate_entry", f"{VALIDATE_SQL.replace('SELECT * FROM i WHERE n > 0', '')}, k AS (SELECT * FROM i WHERE n > 0) SELECT count(*) FILTER (WHERE severity = 'error') = 0 AS valid, count(*) FILTER (WHERE severity = 'error') AS n_errors, count(*) FILTER (WHERE severity = 'warning') AS n_warnings, (SELECT count(*) FROM cards) AS total_rows, (SELECT string_agg(DISTINCT note_type, ',' ORDER BY note_type) FROM cards) AS note_types, (SELECT count(*) FROM (SELECT DISTINCT {strip('x')} AS x FROM (SELECT unnest(string_split(media, ';')) AS x FROM cards)) WHERE x <> '') AS media_files FROM k")
def validate_entry(spark, sf):
    r = validate.report(cards(spark, sf), spark.createDataFrame([("a0.png",), ("b.png",)], "name string"))
    return r.withColumn("note_types", F.array_join("note_types", ","))


@query("validate_rows", f"""{C}, m AS (SELECT card_ord, note_type, CASE WHEN card_ord % 13 = 0 THEN 'x' WHEN card_ord % 17 = 0 THEN repeat('long', 30) ELSE id END AS id, CASE WHEN card_ord % 9 = 0 THEN repeat('{{{{c1::a}}}} ', 7) ELSE cloze_text END AS cloze_text FROM cards),
r AS (SELECT *, row_number() OVER (ORDER BY card_ord) - 1 AS row, CAST(len(regexp_extract_all(cloze_text, '{CLOZE_RE}')) AS BIGINT) AS n FROM m)
SELECT row, 'short_id' AS rule, id AS detail FROM r WHERE id <> '' AND length(id) < 4 UNION ALL SELECT row, 'long_id', substr(id, 1, 20) FROM r WHERE length(id) > 100 UNION ALL SELECT row, 'many_cloze', CAST(n AS VARCHAR) FROM r WHERE note_type = 'Cloze' AND n > 5""")
def validate_rows(spark, sf):
    o = F.col("card_ord")
    c = cards(spark, sf).withColumns({
        "id": F.when(o % 13 == 0, "x").when(o % 17 == 0, F.repeat(F.lit("long"), F.lit(30))).otherwise(F.col("id")),
        "cloze_text": F.when(o % 9 == 0, F.repeat(F.lit("{{c1::a}} "), F.lit(7))).otherwise(F.col("cloze_text")),
    })
    return validate.row_warnings(c).withColumn("row", F.col("row").cast("bigint"))


RULES = " UNION ALL ".join(
    [f"SELECT '{t}' AS note_type, '{f}' AS field, 'empty' AS rule, count(*) AS n FROM cards WHERE note_type = '{t}' AND {_blank(f)}" for t, f in (("Basic", "front"), ("Basic", "back"), ("Cloze", "cloze_text"))]
    + [f"SELECT '{t}', '{f}', 'too_long', count(*) FROM cards WHERE note_type = '{t}' AND length({f}) > {n}" for t, f, n in (("Basic", "front", 500), ("Basic", "back", 1000), ("Basic", "extra", 500), ("Cloze", "cloze_text", 800), ("Cloze", "extra", 500))]
    + [f"SELECT 'Cloze', 'cloze_text', 'no_cloze', count(*) FROM cards WHERE note_type = 'Cloze' AND NOT {_blank('cloze_text')} AND len(regexp_extract_all(cloze_text, '{CLOZE_RE}')) = 0"]
)


@query("note_type_rules", f"{C} SELECT * FROM ({RULES}) WHERE n > 0")
def note_type_rules(spark, sf):
    return validate.broken_rules(cards(spark, sf))


@query("strategies_used", f"{C} SELECT string_agg(DISTINCT strategy, ',' ORDER BY strategy) AS strategies, string_agg(DISTINCT note_type, ',' ORDER BY note_type) AS note_types FROM cards")
def strategies_used(spark, sf):
    return telemetry.used(cards(spark, sf)).select(*[F.array_join(c, ",").alias(c) for c in ("strategies", "note_types")])


@query("deck_name_check", rf"""WITH n AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'A::B' WHEN 1 THEN ' lead' WHEN 2 THEN 'fine name' WHEN 3 THEN ' ' ELSE 'a/b' END AS name FROM documents) SELECT doc_id, {strip('name')} <> '' AND {strip('name')} = name AND NOT regexp_matches(name, '[<>:"|?*/\\]') AS ok FROM n""")
def deck_name_check(spark, sf):
    k = F.col("doc_id") % 5
    return v.table(spark, sf, "documents").select("doc_id", validate.deck_name_ok(F.when(k == 0, "A::B").when(k == 1, " lead").when(k == 2, "fine name").when(k == 3, " ").otherwise("a/b")).alias("ok"))


DECK = "CASE WHEN coalesce(trim(section), '') <> '' THEN 'D::' || section ELSE 'D' END"
# source, page and section, each a field of its own
SOURCE = "CASE WHEN coalesce(source_pdf, '') = '' THEN 'Unknown' ELSE string_split(source_pdf, '/')[-1] END"
PAGE = "CASE WHEN page_start IS NULL OR page_start = 0 THEN '' WHEN page_end IS NULL OR page_end = 0 OR page_end = page_start THEN 'p. ' || CAST(page_start AS VARCHAR) ELSE 'pp. ' || CAST(page_start AS VARCHAR) || '-' || CAST(page_end AS VARCHAR) END"
TAGS = f"""dt AS (SELECT card_ord, unnest(string_split(tags, ';')) AS t, unnest(range(len(string_split(tags, ';')))) AS i FROM cards UNION ALL SELECT card_ord, 'strategy:' || strategy, 100 FROM cards UNION ALL SELECT card_ord, 'type:' || note_type, 101 FROM cards),
du AS (SELECT card_ord, lower(replace({strip('t')}, ' ', '_')) AS t, min(i) AS i FROM dt WHERE {strip('t')} <> '' GROUP BY 1, 2), dtags AS (SELECT card_ord, string_agg(t, ',' ORDER BY i) AS tags FROM du GROUP BY card_ord)"""


@query("deck_assignment", f"{C} SELECT {DECK} AS deck, count(*) AS n_cards FROM cards GROUP BY 1")
def deck_assignment(spark, sf):
    return deck.decks(cards(spark, sf), "D", "by_chapter")


@query("deck_themes", f"{C} SELECT card_ord, 'D::' || CASE strategy WHEN 'key_points' THEN 'Key Points' ELSE 'Cloze Definitions' END AS deck FROM cards")
def deck_themes(spark, sf):
    return cards(spark, sf).select("card_ord", deck.deck_of("D", "by_theme").alias("deck"))


@query("source_info", f"{C} SELECT card_ord, {SOURCE} AS source, {PAGE} AS page, coalesce(section, '') AS section FROM cards")
def source_info(spark, sf):
    return cards(spark, sf).select("card_ord", deck.source_info().alias("i")).select("card_ord", "i.*")


@query("deck_tags", f"{C}, {TAGS} SELECT card_ord, tags FROM dtags")
def deck_tags(spark, sf):
    return tagged(spark, sf).select("card_ord", F.array_join(deck.deck_tags(), ",").alias("tags"))


NOTE_SQL = f"""SELECT c.card_ord, {DECK} AS deck, note_type AS model, CASE note_type
  WHEN 'Basic' THEN list_value(front, back, {SOURCE}, {PAGE}, coalesce(section, ''), replace(d.tags, ',', ';'), coalesce(extra, ''))
  ELSE list_value(cloze_text, coalesce(extra, ''), {SOURCE}, {PAGE}, coalesce(section, ''), replace(d.tags, ',', ';')) END AS f, d.tags
  FROM cards c JOIN dtags d ON d.card_ord = c.card_ord WHERE note_type IN ('Basic', 'Cloze')"""


@query("build_notes", f"{C}, {TAGS} SELECT card_ord, deck, model, array_to_string(f, '~') AS fields, tags FROM ({NOTE_SQL})")
def build_notes(spark, sf):
    # the notes carry no ordinal; it is given as their id here
    n = deck.notes(tagged(spark, sf).withColumn("id", F.col("card_ord").cast("string")), "D", "by_chapter")
    return n.select(F.col("guid").cast("bigint").alias("card_ord"), "deck", "model", F.array_join("fields", "~").alias("fields"), F.array_join("tags", ",").alias("tags"))


@query("preview_projection", f"""{C} SELECT card_ord, coalesce(substr(id, 1, 12), '') AS short_id, CASE WHEN length(a) > 80 THEN substr(a, 1, 80) || '...' ELSE a END AS side_a, array_to_string(t[1:3], ', ') || CASE WHEN len(t) > 3 THEN ' (+' || CAST(len(t) - 3 AS VARCHAR) || ')' ELSE '' END AS tags
FROM (SELECT *, CASE WHEN note_type = 'Cloze' THEN cloze_text ELSE front END AS a, list_filter(list_transform(string_split(cards.tags, ';'), lambda x: trim(x)), lambda x: x <> '') AS t FROM cards) ORDER BY card_ord LIMIT 10""")
def preview_projection(spark, sf):
    p = deck.previews(tagged(spark, sf), 10)
    return p.select("card_ord", F.coalesce("short_id", F.lit("")).alias("short_id"), "side_a", "tags")


REG = "reg AS (SELECT 'f' || CAST(doc_id AS VARCHAR(20)) AS key, doc_id % 4 <> 0 AS enabled, CASE WHEN doc_id % 2 = 0 THEN 'textbook' ELSE 'unknown' END AS doc_type, doc_id % 90 AS page_count, CASE WHEN doc_id % 3 = 0 THEN 'smart' ELSE NULL END AS override_mode, CASE WHEN doc_id % 5 = 0 THEN 'sections' ELSE NULL END AS heuristic_mode, CASE WHEN doc_id % 7 = 0 THEN 1500 ELSE NULL END AS heuristic_tokens FROM documents)"
SCAN = "scan AS (SELECT CASE WHEN doc_id % 3 = 1 THEN 'new' ELSE 'f' END || CAST(doc_id AS VARCHAR(20)) AS key, 'research_paper' AS doc_type, doc_id % 80 + 1 AS page_count, 'day2' AS last_scanned FROM documents)"


def _reg(spark, sf):
    return spark.sql("WITH " + v._named(REG, {"documents": 0}) + " SELECT *, 'day1' AS last_scanned FROM reg", documents=v.table(spark, sf, "documents"))


@query("registry_upsert", f"""WITH {REG}, {SCAN} SELECT key, coalesce(r.enabled, TRUE) AS enabled, coalesce(s.doc_type, r.doc_type) AS doc_type, coalesce(s.page_count, r.page_count) AS page_count, coalesce(s.last_scanned, 'day1') AS last_scanned, coalesce(r.override_mode, '') AS override_mode FROM reg r FULL JOIN scan s USING (key)""")
def registry_upsert(spark, sf):
    s = spark.sql("WITH " + v._named(SCAN, {"documents": 0}) + " SELECT * FROM scan", documents=v.table(spark, sf, "documents"))
    return registry.upserted(_reg(spark, sf), s).withColumn("override_mode", F.coalesce("override_mode", F.lit("")))


@query("config_layering", f"WITH {REG} SELECT key, coalesce(override_mode, heuristic_mode, 'pages') AS mode, CAST(coalesce(heuristic_tokens, 2000) AS BIGINT) AS tokens, 9 AS overlap FROM reg")
def config_layering(spark, sf):
    out = registry.layered(_reg(spark, sf), {"mode": "pages", "tokens": 2000, "overlap": 200}, {"overlap": 9})
    return out.withColumn("tokens", F.col("tokens").cast("bigint"))


@query("registry_type_counts", f"WITH {REG} SELECT doc_type, count(*) AS n FROM reg WHERE enabled GROUP BY doc_type")
def registry_type_counts(spark, sf):
    return registry.type_counts(registry.enabled(_reg(spark, sf)))


COST = "tokens_in / 1000.0 * CASE model WHEN 'gpt-4' THEN 0.03 WHEN 'gpt-3.5-turbo' THEN 0.001 ELSE 0.01 END + tokens_out / 1000.0 * CASE model WHEN 'gpt-4' THEN 0.06 WHEN 'gpt-3.5-turbo' THEN 0.002 ELSE 0.03 END"


@query("model_registry", f"""{v.ctes('calls')}, m AS (SELECT * FROM (VALUES ('gpt-4-1106-preview', 128000, TRUE, TRUE), ('gpt-4', 8192, FALSE, FALSE), ('gpt-3.5-turbo', 16385, TRUE, FALSE)) t(model, context_length, json, seed))
SELECT c.model, count(*) AS calls, coalesce(max(context_length), 0) AS context_length, coalesce(bool_or(json), FALSE) AS supports_json, coalesce(bool_or(seed), FALSE) AS supports_seed, count(*) FILTER (WHERE tokens_in + tokens_out > context_length) AS too_long FROM calls c LEFT JOIN m ON m.model = c.model GROUP BY c.model""")
def model_registry(spark, sf):
    """What the models that were called can do, and how many calls are beyond their context."""
    return telemetry.models_used(v.calls(spark, sf))


@query("llm_usage", f"{v.ctes('calls')} SELECT CAST(sum(tokens_in + tokens_out) AS BIGINT) AS total_tokens, count(*) AS api_calls, count(*) FILTER (WHERE cached) AS cache_hits, count(*) FILTER (WHERE cached) / greatest(count(*), 1) AS cache_hit_rate FROM calls")
def llm_usage(spark, sf):
    return generation.usage(v.calls(spark, sf))


@query("model_cost", f"{v.ctes('calls')} SELECT model, count(*) AS calls, round(sum(CAST({COST} AS DOUBLE)), 4) AS cost FROM calls GROUP BY model")
def model_cost(spark, sf):
    return telemetry.with_cost(v.calls(spark, sf)).groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost"), 4).alias("cost"))


@query("telemetry_rollup", f"{v.ctes('calls')} SELECT coalesce(strategy, '(all)') AS strategy, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS tokens, round(sum(CAST({COST} AS DOUBLE)), 4) AS cost, CAST(sum(cached::INT) AS BIGINT) AS cache_hits, count(*) AS calls, CAST(sum(cards) AS BIGINT) AS cards FROM calls GROUP BY ROLLUP (calls.strategy)")
def telemetry_rollup(spark, sf):
    c = telemetry.with_cost(v.calls(spark, sf)).withColumn("tokens", F.col("tokens_in") + F.col("tokens_out"))
    return telemetry.rolled_up(c).withColumn("strategy", F.coalesce("strategy", F.lit("(all)"))).withColumn("cost", F.round("cost", 4))


@query("cache_hit_rate", f"{v.ctes('calls')} SELECT strategy, CAST(sum(cached::INT) AS BIGINT) AS hits, count(*) AS calls, round_even(sum(cached::INT) / greatest(count(*), 1), 3) AS hit_rate FROM calls GROUP BY strategy")
def cache_hit_rate(spark, sf):
    return telemetry.hit_rates(v.calls(spark, sf))
