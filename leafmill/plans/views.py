"""The engine's inputs derived from the driver's tables. SQL texts here mean the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_LINES = 5

PAPERS = """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Abstract' || chr(10) ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN 'Chapter 1' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 11 = 0 THEN 'doi: 10.1234/x' || chr(10) ELSE '' END || text || CASE WHEN doc_id % 13 = 0 THEN chr(10) || 'RESULTS' || chr(10) || 'It held.' ELSE '' END
  || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'References' || chr(10) || '1. cited' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN chr(10) || ' see figure 1' ELSE '' END AS text
FROM documents
"""
HEADINGS = """
SELECT doc_id, line_no AS ord, line || CASE WHEN line_no % 6 = 0 THEN ' Part' ELSE '' END AS text, CAST(floor(line_no / 5) AS INT) + 1 AS page,
  CAST(CASE WHEN line_no % 4 = 0 THEN 1 + doc_id % 3 ELSE 3 END AS INT) AS level FROM lines
"""
SPANS = """
SELECT doc_id, CAST(floor(line_no / 5) AS INT) + 1 AS page_num, 0 AS block_no, line_no, CAST(k AS INT) AS span_no, CASE WHEN k = 0 THEN substr(line, 1, 20) ELSE substr(line, 21) END AS text,
  CAST(12 + CASE WHEN line_no % 4 = 0 THEN doc_id % 7 ELSE 0 END AS DOUBLE) AS size, CASE WHEN line_no % 5 = 0 AND k = 1 THEN 16 ELSE 0 END AS flags FROM lines CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) s
"""
CARDS = """
SELECT doc_id AS card_ord, CASE WHEN doc_id % 50 = 49 THEN NULL WHEN doc_id % 61 = 0 THEN '' ELSE 'card' || CAST(doc_id % 900 AS VARCHAR(20)) END AS id,
  CASE WHEN doc_id % 97 = 96 THEN 'Other' WHEN doc_id % 3 = 0 THEN 'Cloze' ELSE 'Basic' END AS note_type,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE split_part(text, chr(10), 1) END AS front, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 41 = 0 THEN ' ' ELSE substr(text, length(split_part(text, chr(10), 1)) + 2) END AS back,
  CASE WHEN doc_id % 3 <> 0 THEN '' WHEN doc_id % 39 = 0 THEN 'none here' ELSE '{{c1::' || split_part(text, ' ', 1) || '}} ' || text END AS cloze_text,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'extra ' || CAST(doc_id % 10 AS VARCHAR(20)) END AS extra, CASE WHEN doc_id % 8 = 7 THEN '' ELSE 'in/f' || CAST(doc_id % 7 AS VARCHAR(20)) || '.pdf' END AS source_pdf,
  CAST(doc_id % 9 + 1 AS INT) AS page_start, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE CAST(doc_id % 9 + 1 + doc_id % 2 AS INT) END AS page_end, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'S' || CAST(doc_id % 4 AS VARCHAR(20)) END AS section,
  CASE WHEN doc_id % 3 = 0 THEN 'cloze_definitions' ELSE 'key_points' END AS strategy, 'C' || CAST(doc_id % 50 AS VARCHAR(20)) AS core_concept, CASE WHEN doc_id % 4 = 1 THEN 'vague' WHEN doc_id % 4 = 2 THEN 'hard' ELSE 'easy' END AS difficulty,
  ' Tag ' || CAST(doc_id % 6 AS VARCHAR(20)) || ';x y;;Tag ' || CAST(doc_id % 6 AS VARCHAR(20)) AS tags, CASE WHEN doc_id % 10 = 0 THEN 'a' || CAST(doc_id % 30 AS VARCHAR(20)) || '.png; b.png' ELSE '' END AS media, 'main' AS deck,
  CASE WHEN doc_id % 12 = 0 THEN '' ELSE 'p. ' || CAST(doc_id % 9 + 1 AS VARCHAR(20)) END AS page_citation, 'p. ' || CAST(doc_id % 9 + 1 AS VARCHAR(20)) AS ref_citation
FROM documents
"""
#: Every user turn is a card, with the assistant's answer where one follows. Those of two conversations in three come again without some letters:
#: once close to the first, once so far that only the close one still resembles it.
TURNS = """
SELECT (conv_id * 1000000 + turn) * 3 + k AS card_ord, 'Basic' AS note_type, CASE k WHEN 0 THEN text WHEN 1 THEN translate(text, 'en', '') ELSE translate(text, 'enta', '') END AS front,
  answer AS back, '' AS cloze_text, CAST(NULL AS VARCHAR(20)) AS extra,
  'conv' || CAST(conv_id AS VARCHAR(20)) AS source_pdf, CAST(turn + 1 AS INT) AS page_start, CAST(turn + 2 AS INT) AS page_end
FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE WHEN lead(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant' THEN coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') ELSE '' END AS answer FROM conversations) t
CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k) v WHERE role = 'user' AND (k = 0 OR conv_id % 3 <> 0)
"""
PROMPTS = "SELECT card_ord, note_type, front, '' AS back, cloze_text, extra FROM turn_cards"
CALLS = """
SELECT event_type AS strategy, CASE WHEN user_id % 3 = 0 THEN 'gpt-4' WHEN user_id % 3 = 1 THEN 'gpt-3.5-turbo' ELSE 'other' END AS model, CAST(user_id % 500 AS BIGINT) AS tokens_in, CAST(event_id % 300 AS BIGINT) AS tokens_out,
  event_id % 4 = 0 AS cached, CAST(event_id % 3 AS BIGINT) AS cards, event_id FROM events
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    # named arguments keep the query free of temporary views
    return spark.sql(_named(text, tables), **tables)


def _named(text: str, tables: dict) -> str:
    text = text.replace("{", "{{").replace("}", "}}")
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return text.replace("VARCHAR(20)", "STRING")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lines a page, each a paragraph. Pages are cut inside the row, so nothing is shuffled."""
    return paged(table(spark, sf_dir, "documents"))


def paged(docs: DataFrame) -> DataFrame:
    ls = docs.select("doc_id", F.split("text", "\n").alias("l"))
    starts = F.sequence(F.lit(0), F.size("l") - 1, F.lit(PAGE_LINES))
    p = ls.select("doc_id", "l", F.explode(starts).alias("s"))
    return p.select("doc_id", (F.col("s") / PAGE_LINES + 1).cast("int").alias("page_num"), F.array_join(F.slice("l", F.col("s") + 1, F.lit(PAGE_LINES)), "\n\n").alias("raw_text"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, PAPERS, documents=table(spark, sf_dir, "documents"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, HEADINGS, lines=lines(spark, sf_dir))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, SPANS, lines=lines(spark, sf_dir))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, CARDS, documents=table(spark, sf_dir, "documents"))


def turn_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, TURNS, conversations=table(spark, sf_dir, "conversations"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards' questions alone."""
    return _sql(spark, PROMPTS, turn_cards=turn_cards(spark, sf_dir))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, CALLS, events=table(spark, sf_dir, "events"))


#: The same views for DuckDB.
LINES_SQL = "SELECT doc_id, CAST(line_no AS INT) AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)"
PAGES_SQL = "SELECT doc_id, CAST(line_no // 5 + 1 AS INT) AS page_num, string_agg(line, chr(10) || chr(10) ORDER BY line_no) AS raw_text FROM lines GROUP BY doc_id, line_no // 5"


def ctes(*names: str) -> str:
    """WITH clauses for the named views and those they need."""
    all_ = {"lines": LINES_SQL, "pages": PAGES_SQL, "papers": PAPERS, "headings": HEADINGS, "spans": SPANS, "cards": CARDS, "turn_cards": TURNS, "prompts": PROMPTS, "calls": CALLS}
    needs = {"pages": ["lines"], "headings": ["lines"], "spans": ["lines"]}
    order: list[str] = []
    for n in names:
        for x in [*needs.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({all_[n]})" for n in order)
