"""Shared pieces: staged tables in the shared folder, Arrow scans, one model at a time in a worker."""

from __future__ import annotations

import ctypes
import os
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.plans.ship import ship

#: Rows (and so bytes, as every row has a fixed small width) a side may have to be broadcast.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir``; where that is unset a temporary one, in local
    mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="leafmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._leafmill_path = path
    _open.append(path)
    return out


#: Staged tables of this process that nobody has deleted.
_open: list[str] = []


def staged() -> int:
    """How many staged tables there are now: what ``clear`` takes as the place to begin at."""
    return len(_open)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Deletes the staged tables made since. Only for when everything that reads them has been written or collected: a lazy
    result reads its staged tables until then."""
    for path in _open[since:]:
        delete(spark, path)
    del _open[since:]


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def unstage(df: DataFrame) -> None:
    """Deletes a staged table that no later plan reads."""
    path = getattr(df, "_leafmill_path", None)
    if path:
        delete(df.sparkSession, path)
        if path in _open:
            _open.remove(path)


def only(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """Only the named columns, so extra input columns can't clash with computed ones."""
    return docs.select(*columns)


def scan(
    df: DataFrame, schema: str, one: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None],
    last: Callable[[], dict | None] | None = None,
) -> DataFrame:
    """Maps Arrow batches of ``df`` through ``one``; ``schema`` is a DDL string."""
    return scan_with(df, schema, lambda: (one, last))


def scan_with(df: DataFrame, schema: str, make: Callable[[], tuple[Callable, Callable | None]]) -> DataFrame:
    """As ``scan``; ``make`` runs once in each task and returns (for each batch, at the end or None)."""
    ship(df.sparkSession)
    return df.mapInArrow(_scanner(schema, make), schema)


def _scanner(schema: str, make: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, last = make()

        def out(x):
            if isinstance(x, dict):
                x = pa.RecordBatch.from_arrays([pa.array(x[f.name], type=f.type) for f in target], schema=target)
            return x

        for b in batches:
            # long texts: two megabytes at a time
            step = max(1, int(b.num_rows * 2e6 / max(b.nbytes, 1)))
            for i in range(0, b.num_rows, step):
                if (x := one(b.slice(i, step))) is not None:
                    yield out(x)
        if last is not None and (x := last()) is not None:
            yield out(x)
        _release()

    return run


def _release() -> None:
    """Gives freed memory back to the system: a worker waits for its next task, of any operator, with what it holds."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


_held: dict[str, object] = {}


def held(key: str, make: Callable[[], object]):
    """The object of a key, made once in a worker process. A worker holds one at a time: Spark uses it again for other
    operators' tasks, whose models and caches would add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants from a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def starts_of(counts: list[int] | np.ndarray) -> np.ndarray:
    """0 and the running sums of counts."""
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold_of(column: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4: fold 2 is held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(fold_of(column) == 2, F.lit(False))


def broadcast_if_small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint when the counted rows are few; else a plain (shuffled, skew-splittable) join side."""
    return F.broadcast(df) if rows <= most else df


#: Bits of the map that ``maybe_among`` sends to all tasks (8 MB).
ID_BITS = 1 << 26


def maybe_among(rows: DataFrame, ids: DataFrame, column: str, bits: int = ID_BITS) -> DataFrame:
    """``rows`` whose ``column`` may be among the ids, and few others: a bitmap of the ids' hashes, set by an aggregate and of a
    fixed size, turns the rest away before anything is shuffled. What remains has still to be joined."""
    spark = rows.sparkSession
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    words = ids.select(place.alias("b")).groupBy(F.shiftright("b", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(b & 31))")).alias("mask")).toArrow()  # bits / 32 rows at most
    seen = np.zeros(bits >> 5, np.uint32)
    seen[words["word"].to_numpy()] = words["mask"].to_numpy().astype(np.uint32)
    sent = spark.sparkContext.broadcast(seen)
    ship(spark)

    @F.pandas_udf("boolean")
    def may(at: pd.Series) -> pd.Series:
        b = at.to_numpy()
        return pd.Series((sent.value[b >> 5] >> (b & 31).astype(np.uint32)) & 1 == 1)

    return rows.where(may(place))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def single_thread() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
