"""Token ids in a compact file: canonical, length-limited Huffman codes from global counts.

The file format is a Parquet table with one row for each document, in ascending doc_id order within and across
shards (rows of equal doc_id in order of their ids' checksum):

* ``shard`` int, ``doc_id``, ``n_ids`` int;
* ``bits`` binary: the ids' codes one after another, most significant bit first, padded to whole bytes;
* ``marks`` binary: little-endian unsigned 32-bit bit offsets of ids 0, ``EVERY``, 2 ``EVERY``, ... (the checkpoints,
  from which decoding can start independently).

and a second table with one row for each code: ``id`` and ``width``. Codes are canonical: in order of (width, id),
each is the one before plus one, shifted left where the width grows. So widths alone define them. Every id of the
vocabulary has a count of at least one, so a file can be extended later with the same code.

The package-merge algorithm gives the best widths of at most ``MOST_BITS`` bits. Decoding looks ``MOST_BITS`` bits up
in one table and runs over all checkpoints of a batch in step.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import only, scan, scan_with, stage, starts_of, text_or_empty, tokenizer_path, unstage
from leafmill.llm.tokens import bpe
from leafmill.llm.words import binary_array, spread, text_bytes

MOST_BITS = 16
EVERY = 128


def code_widths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Best code widths of at most ``most`` bits for counts >= 1 (package-merge)."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.uint8)
    if n > 1 << most:
        raise ValueError(f"{n} ids don't fit into codes of {most} bits")
    order = np.argsort(counts, kind="stable")
    base = counts[order].astype(np.float64)
    # of each level, how many of its packages' leaves come before each place: only leaf counts are needed to walk back
    levels, merged = [], base
    for _ in range(most - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([base, pairs])
        at = np.argsort(both, kind="stable")
        levels.append(at < n)
        merged = both[at]
    width, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(levels):
        k = int(leaf[:take].sum())
        width[:k] += 1
        take = 2 * (take - k)
    width[:take] += 1
    out = np.empty(n, np.uint8)
    out[order] = width
    return out


def canonical(widths: np.ndarray) -> np.ndarray:
    """The code of each id, as the low bits."""
    order = np.lexsort((np.arange(len(widths)), widths))
    w = widths[order].astype(np.int64)
    first = np.concatenate([[0], np.cumsum(1 << (MOST_BITS - w))[:-1]])
    out = np.empty(len(widths), np.uint32)
    out[order] = first >> (MOST_BITS - w)
    return out


def decode_table(widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and width for each value of the next ``MOST_BITS`` bits."""
    order = np.lexsort((np.arange(len(widths)), widths))
    runs = 1 << (MOST_BITS - widths[order].astype(np.int64))
    ids, bits = np.zeros(1 << MOST_BITS, np.uint32), np.ones(1 << MOST_BITS, np.int64)
    filled = int(runs.sum())
    ids[:filled], bits[:filled] = np.repeat(order, runs), np.repeat(widths[order], runs)
    return ids, bits


def encode_table(widths: np.ndarray) -> np.ndarray:
    """Code in the low bits and width in the top byte, for each id."""
    return canonical(widths).astype(np.uint64) | widths.astype(np.uint64) << np.uint64(56)


def encode(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The bits of runs of ids (``counts`` of them each, one after another), and each run's checkpoints."""
    both = np.take(codes, ids)
    w = (both >> np.uint64(56)).view(np.int64)
    at, first = starts_of(w), starts_of(counts)
    begin = at[first]
    size = np.diff(begin)
    base = starts_of((size + 31) // 32)  # each run begins at a 32-bit word of its own
    place = at[:-1] + np.repeat(base[:-1] * 32 - begin[:-1], counts)
    # each code lands in one word or in two
    words = np.zeros(int(base[-1]) + 1, np.uint64)
    wide = both << (64 - (place & 31) - w).view(np.uint64)
    k = place >> 5
    if len(k):
        heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        got = np.bitwise_or.reduceat(wide, heads)
        words[k[heads]] |= got >> np.uint64(32)
        words[k[heads] + 1] |= got & np.uint64(0xFFFFFFFF)
    raw, length = words.astype(">u4").view(np.uint8), (size + 7) // 8
    marked = -(-counts // EVERY)
    ids_at = np.repeat(first[:-1], marked) + spread(np.zeros(len(counts), np.int64), marked) * EVERY
    marks = (at[ids_at] - np.repeat(begin[:-1], marked)).astype("<u4").view(np.uint8)
    return binary_array(raw[spread(base[:-1] * 4, length)], starts_of(length)).cast(pa.binary()), binary_array(marks, starts_of(marked * 4)).cast(pa.binary())


def decode(bits: np.ndarray, at: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Decodes runs that begin at bit offsets ``at`` with ``counts`` ids each, in step; gives the ids run after run.

    ``bits``: the bytes, with at least four more behind the last run.
    """
    ids, width = table
    out = np.empty(int(counts.sum()), np.uint32)
    to = starts_of(counts)[:-1]
    order = np.argsort(-counts, kind="stable")
    at, to, left = at[order].copy(), to[order], counts[order]
    b = bits.astype(np.uint32)
    for step in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -step, side="left"))  # runs with more than ``step`` ids
        a = at[:live]
        k = a >> 3
        window = (b[k] << np.uint32(16)) | (b[k + 1] << np.uint32(8)) | b[k + 2]
        look = (window >> (8 - (a & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        out[to[:live] + step] = ids[look]
        at[:live] += width[look]
    return out


@lru_cache(maxsize=2)
def _coder(widths: bytes) -> tuple:
    w = np.frombuffer(widths, np.uint8)
    return encode_table(w), decode_table(w)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """doc_id and ids (binary, little-endian, 16 bits each where the vocabulary allows), the end id last; one more row
    at each task's end has a null ``ids`` and the task's counts of ids."""
    kind = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")

    def make():
        counts = np.zeros(vocabulary, np.int64)

        def one(b: pa.RecordBatch) -> dict:
            ids, n = bpe(tokenizer).encode(b.column("text"))
            whole = np.insert(ids, starts_of(n)[1:], end_id)
            counts.__iadd__(np.bincount(whole, minlength=vocabulary))
            out = binary_array(whole.astype(kind).view(np.uint8), starts_of((n + 1) * kind.itemsize)).cast(pa.binary())
            return {"doc_id": b.column("doc_id"), "ids": out, "counts": pa.nulls(len(out), pa.binary())}

        def last() -> dict | None:
            return {"doc_id": [None], "ids": [None], "counts": [counts.astype("<i8").tobytes()]} if counts.any() else None

        return one, last

    return scan_with(only(docs, "doc_id", text_or_empty().alias("text")), "doc_id bigint, ids binary, counts binary", make)


def _sum_counts(df: DataFrame, vocabulary: int) -> np.ndarray:
    """The tasks' counts, summed per id on the executors; the driver gets one number for each id of the vocabulary."""

    def one(b: pa.RecordBatch) -> dict:
        total = np.sum([np.frombuffer(x, "<i8") for x in b.column("counts").to_pylist()], axis=0)
        ids = np.flatnonzero(total)
        return {"id": ids.astype(np.int32), "n": total[ids]}

    rows = scan(df.where("counts is not null").select("counts"), "id int, n bigint", one).groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.ones(vocabulary, np.int64)
    out[rows["id"].to_numpy()] += rows["n"].to_numpy(dtype=np.int64)
    return out


def range_of(df: DataFrame, column: str, parts: int) -> tuple[DataFrame, list]:
    """Bounds that cut ``column`` into about equal parts, from one aggregate; ``parts`` bounds the list."""
    q = [i / parts for i in range(1, parts)]
    got = df.select(F.percentile_approx(column, F.array(*map(F.lit, q)), F.lit(max(1000, 4 * parts))).alias("q")).first()["q"] if q else None
    return sorted(set(got or []))


def bucket_of(column: str, bounds: list) -> F.Column:
    """How many bounds are <= the value: two short searches, of about the root of the list each."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    whole = F.array(*map(F.lit, bounds))
    heads = F.array(*map(F.lit, bounds[::step]))
    k = F.size(F.filter(heads, lambda x: x <= F.col(column)))
    tail = F.slice(whole, F.greatest(k - 1, F.lit(0)) * step + 1, F.lit(step))
    return F.when(F.col(column).isNull() | (k == 0), 0).otherwise((k - 1) * step + F.size(F.filter(tail, lambda x: x <= F.col(column))))


#: ids_crc32: of all ids as little-endian unsigned 32-bit integers.
FILE = "shard int, doc_id bigint, n_ids int, ids_crc32 bigint, bits binary, marks binary"


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, vocabulary: int = 50257, shards: int | None = None) -> None:
    """Encodes every text and writes ``path``/ids and ``path``/code.

    Null and empty texts hold the end id alone. Repeated rows are written once for each row; a null doc_id comes
    first. An empty table gives empty tables. Other columns are ignored.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_of(docs.select("doc_id"), "doc_id", shards)
    staged = stage(tokenized(docs, tokenizer or tokenizer_path(), end_id, vocabulary), "ids", compression="zstd")
    widths = code_widths(_sum_counts(staged, vocabulary)).tobytes()
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def one(b: pa.RecordBatch) -> dict:
        codes = _coder(widths)[0]
        raw, at = text_bytes(b.column("ids"))
        n = np.diff(at) // np.dtype(kind).itemsize
        bits, marks = encode(raw.view(kind), n, codes)
        whole, ends = memoryview(raw.view(kind).astype("<u4").tobytes()), (starts_of(n) * 4).tolist()
        return {"shard": b.column("shard"), "doc_id": b.column("doc_id"), "n_ids": n, "ids_crc32": [zlib.crc32(whole[i:j]) for i, j in zip(ends, ends[1:])], "bits": bits, "marks": marks}

    rows = staged.where("ids is not null").select(bucket_of("doc_id", bounds).cast("int").alias("shard"), "doc_id", "ids")
    rows = scan(rows, FILE, one).repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "ids_crc32", "n_ids")
    rows.write.option("compression", "none").parquet(f"{path}/ids")
    unstage(staged)
    w = np.frombuffer(widths, np.uint8)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(w)], "id int, width int").coalesce(1).write.parquet(f"{path}/code")


def read(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc_id, ids (binary, little-endian unsigned 32-bit) of every document in a file."""
    def of(b: pa.RecordBatch, ids: np.ndarray, n: np.ndarray) -> dict:
        return {"shard": b.column("shard"), "doc_id": b.column("doc_id"), "ids": binary_array(ids.astype("<u4").view(np.uint8), starts_of(n * 4)).cast(pa.binary())}

    return _decoded(spark, path, "shard int, doc_id bigint, ids binary", of)


def _decoded(spark: SparkSession, path: str, schema: str, of) -> DataFrame:
    code = spark.read.parquet(f"{path}/code").toPandas().sort_values("id")  # one row for each id of the vocabulary
    widths = code["width"].to_numpy(np.uint8).tobytes()

    def one(b: pa.RecordBatch) -> dict:
        table = _coder(widths)[1]
        n = b.column("n_ids").to_numpy().astype(np.int64)
        bits, base = text_bytes(b.column("bits"))
        marks, mark_at = text_bytes(b.column("marks"))
        marked = np.diff(mark_at) // 4
        at = marks.view("<u4").astype(np.int64) + np.repeat(base[:-1] * 8, marked)
        runs = np.minimum(EVERY, np.repeat(n, marked) - spread(np.zeros(len(n), np.int64), marked) * EVERY)
        return of(b, decode(np.concatenate([bits, np.zeros(4, np.uint8)]), at, runs, table), n)

    return scan(spark.read.schema(FILE).parquet(f"{path}/ids"), schema, one)


def index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the file alone, decoded.

    ``start`` is the place in the file, whose rows stand in the order of (doc_id, ids_crc32, n_ids): texts of one doc_id
    follow by their checksums, and rows that are equal may stand either way. An empty file gives no rows.
    """
    def of(b: pa.RecordBatch, ids: np.ndarray, n: np.ndarray) -> dict:
        raw, at = memoryview(ids.astype("<u4").tobytes()), (starts_of(n) * 4).tolist()
        return {"shard": b.column("shard"), "doc_id": b.column("doc_id"), "n_tokens": n, "ids_crc32": [zlib.crc32(raw[i:j]) for i, j in zip(at, at[1:])]}

    rows = _decoded(spark, path, "shard int, doc_id bigint, n_tokens bigint, ids_crc32 bigint", of)
    sums = spark.read.schema(FILE).parquet(f"{path}/ids").groupBy("shard").agg(F.sum("n_ids").alias("n"))
    sums = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))  # one row for each shard
    inside = Window.partitionBy("shard").orderBy("doc_id", "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(F.broadcast(sums), "shard")
        .select("doc_id", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")
    )
