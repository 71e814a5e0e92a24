"""Everything of a document file in one scan: metadata, pages, blocks, spans, images, structure.

No extractor comes with the package; one is given as ``(path, bytes) -> dict``:

    {"metadata": {name: text}, "pages": [{"raw_text", "bbox": [4 floats], "rotation",
        "blocks": [{"type": 0 or 1, "bbox", "width", "height", "lines": [[{"text", "font", "size", "flags", "color"}]]}]}],
     "images": [{"page_num", "image_index", "width", "height", "content": bytes, "rects": [[4 floats]]}], "toc": bool}
"""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import BLANK_SIGNS, is_blank
from leafmill.operators import profile, structure
from leafmill.plans.ship import ship
from leafmill.plans.store import settle
from leafmill.sources.files import METADATA

#: What extractors call two of the metadata.
SAID = {"creation_date": "creationDate", "modification_date": "modDate"}
_ROW = "path string, kind string, page_num int, no int, data string, content binary"
_PAGE = "raw_text string, bbox array<double>, rotation int"
_SPAN = "struct<text:string,font:string,size:double,flags:int,color:int>"
_BLOCK = f"type int, bbox array<double>, width int, height int, lines array<array<{_SPAN}>>"
_IMAGE = "width int, height int, rects array<array<double>>"


@dataclass
class Content:
    files: DataFrame
    pages: DataFrame
    blocks: DataFrame
    spans: DataFrame
    images: DataFrame
    headings: DataFrame
    sections: DataFrame
    chapters: DataFrame
    hashes: DataFrame
    profiles: DataFrame
    textless: DataFrame


def _rows(path: str, found: dict, images: bool, first: int, last: int | None):
    meta = found.get("metadata") or {}
    named = {k: meta.get(k, meta.get(SAID.get(k, k))) for k in METADATA}
    stem = os.path.splitext(path.rsplit("/", 1)[-1])[0]
    # only a missing title is replaced, an empty one stays
    named = {k: (stem if k == "title" else "") if v is None else v for k, v in named.items()}
    pages = found.get("pages") or []
    yield path, "file", None, len(pages), json.dumps({**named, "toc": bool(found.get("toc"))}), None
    inside = lambda n: n >= first and (last is None or n <= last)
    for n, p in enumerate(pages, 1):
        if inside(n):
            yield path, "page", n, 0, json.dumps({k: p.get(k) for k in ("raw_text", "bbox", "rotation")}), None
            for k, b in enumerate(p.get("blocks") or []):
                yield path, "block", n, k, json.dumps(b), None
    for i in (found.get("images") or []) if images else []:
        if inside(i["page_num"]):
            yield path, "image", i["page_num"], i["image_index"], json.dumps({k: i.get(k) for k in ("width", "height", "rects")}), i["content"]


def _recognised(path: str, content: bytes, found: dict, ocr: Callable[[str, bytes], list[str]]) -> dict:
    """What was found, with recognised page texts where no page has any; a failing recognition leaves it as it is."""
    pages = found.get("pages") or []
    if any((p.get("raw_text") or "").strip(BLANK_SIGNS) for p in pages):
        return found
    try:
        texts = ocr(path, content)
    except Exception:  # noqa: BLE001  as without recognition
        return found
    more = max(len(pages), len(texts))
    return {**found, "pages": [{**(pages[i] if i < len(pages) else {}), **({"raw_text": texts[i]} if i < len(texts) else {})} for i in range(more)]}


def extract(
    spark: SparkSession, paths: list[str], extractor: Callable[[str, bytes], dict], pattern: str = "*.pdf", images: bool = True, first: int = 1, last: int | None = None,
    ocr_fallback: bool = False, ocr: Callable[[str, bytes], list[str]] | None = None,
) -> Content:
    """All tables of the files, by ``doc_id`` (a hash of the path). Each file is read by the extractor once and what it gave
    is stored; a file that can't be read has no rows. Images under 100 x 100 are left out; an image's box is its first
    place on the page, else the page's.

    ``ocr_fallback``: files without text on any page are read by ``ocr``, which gives a text for each page; without it they
    are warned of. ``textless`` (doc_id, path) are the files that have none in the end, among the pages asked for."""
    ship(spark)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(paths).select("path", "content")

    def run(batches):
        import pyarrow as pa

        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary())
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                try:
                    raw = content.as_py()
                    found = extractor(path, raw)
                    if ocr_fallback and ocr:
                        found = _recognised(path, raw, found, ocr)
                    rows = list(_rows(path, found, images, first, last))
                except Exception:  # noqa: BLE001  one bad file must not end the scan
                    continue
                names = ["path", "kind", "page_num", "no", "data", "content"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    rows = settle(read.mapInArrow(run, _ROW).withColumn("doc_id", F.xxhash64("path")))
    of = lambda kind, schema: rows.where(F.col("kind") == kind).withColumn("x", F.from_json("data", schema))
    files = of("file", ", ".join(f"{c} string" for c in METADATA) + ", toc boolean").select("doc_id", "path", F.col("no").alias("page_count"), "x.*")
    pages = of("page", _PAGE).select("doc_id", "path", "page_num", "x.*")
    raw = of("block", _BLOCK).select("doc_id", "page_num", F.col("no").alias("block_no"), "x.*")
    blocks = structure.blocks_to_lines(raw.withColumn("lines", F.transform("lines", lambda s: F.transform(s, lambda x: x["text"]))))
    spans = raw.where("type = 0").select("doc_id", "page_num", "block_no", F.posexplode("lines").alias("line_no", "l")).select("doc_id", "page_num", "block_no", "line_no", F.posexplode("l").alias("span_no", "s")).select("doc_id", "page_num", "block_no", "line_no", "span_no", "s.*")
    found = structure.image_names(of("image", _IMAGE).select("doc_id", "page_num", F.col("no").alias("image_index"), "x.*", "content"))
    bounds = pages.select("doc_id", "page_num", F.col("bbox").alias("_page"))
    found = found.join(bounds, ["doc_id", "page_num"], "left").withColumn("bbox", F.coalesce(F.get("rects", F.lit(0)), "_page")).drop("rects", "_page")
    heads, sections, chapters = structure.detected(spans)
    textless = files.select("doc_id", "path").join(pages.where(~is_blank(F.col("raw_text"))).select("doc_id"), "doc_id", "left_anti")
    if ocr_fallback and not ocr and (n := textless.count()):
        warnings.warn(f"{n} files have no text, and nothing is given to recognise it", UserWarning, stacklevel=2)
    return Content(files, pages, blocks, spans, found, heads, sections, chapters, structure.text_hash(pages), profile.features(pages, files.where("toc").select("doc_id")), textless)
