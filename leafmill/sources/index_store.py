"""Stored tables that a run touches only in part: an index of hashes behind Bloom filters, and the document registry in buckets.

Both lie in buckets of a key's hash. A bucket's rows are written into a folder of the run that changes it, and a small
table, the pointer, says which folder holds which bucket. A new pointer appears whole, after everything it names; readers
take the newest one, so a run that fails leaves the table as it was, and files of untouched buckets stay as they are.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.dedup import comparison_text, content_hash, first_of
from leafmill.operators.registry import upserted
from leafmill.plans.ship import ship
from leafmill.plans.store import settle

POINTER = "bucket int, folder string, bits binary"


class Bucketed:
    """A table in buckets. ``key``: the column whose hash deals the rows; ``schema``: of the rows, as DDL."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _files(self, path: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return sorted(str(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def version(self) -> int:
        """The newest pointer that was written to its end; 0 where there is none."""
        done = [n for n in self._files(f"{self.path}/pointer") if "_SUCCESS" in self._files(f"{self.path}/pointer/{n}")]
        return max((int(n) for n in done), default=0)

    def pointer(self) -> dict[int, tuple[str, bytes | None]]:
        """bucket -> (folder, filter): one small row for each bucket."""
        v = self.version()
        rows = self.spark.read.schema(POINTER).parquet(f"{self.path}/pointer/{v:012d}").collect() if v else []
        return {r["bucket"]: (r["folder"], None if r["bits"] is None else bytes(r["bits"])) for r in rows}

    def rows(self, only: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets: files of others aren't opened."""
        at = self.pointer()
        paths = [f"{self.path}/data/{f}/bucket={b}" for b, (f, _) in sorted(at.items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def replace(self, rows: DataFrame, touched: list[int], filters: dict[int, bytes] | None = None) -> int:
        """The buckets ``touched`` anew with ``rows`` (which belong to them alone); the new version."""
        old, folder = self.pointer(), uuid.uuid4().hex
        data = f"{self.path}/data/{folder}"
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(data)
        there = {int(n.split("=")[1]) for n in self._files(data) if n.startswith("bucket=")}
        new = {b: x for b, x in old.items() if b not in touched} | {b: (folder, (filters or {}).get(b)) for b in there}
        v = self.version() + 1
        told = self.spark.createDataFrame([(b, f, None if x is None else bytearray(x)) for b, (f, x) in sorted(new.items())], POINTER)
        told.coalesce(1).write.parquet(f"{self.path}/pointer/{v:012d}")
        return v


#: Bits of a bucket's filter for each of its hashes, and hashes of a filter's own; both fixed, so about 2 % pass wrongly.
BITS, PROBES = 8, 4


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES places of each hash (two 64-bit halves of its digest, as one column each)."""
    a, b = h[:, 0], h[:, 1] | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(bits) for k in range(PROBES)], axis=1)


def _halves(hashes: pd.Series) -> np.ndarray:
    """The two halves of hexadecimal digests of 128 bits."""
    raw = b"".join(bytes.fromhex(x) for x in hashes)
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)


class HashIndex(Bucketed):
    """The content hashes of earlier runs. Each bucket has a Bloom filter; a run reads only buckets in which one of its own
    hashes may be. Filters are built where a bucket is rewritten, by one group for each bucket."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        super().__init__(spark, path, "content_hash", "content_hash string", buckets)

    def reached(self, hashes: DataFrame) -> list[int]:
        """The buckets in which some of ``hashes`` (content_hash) may be."""
        filters = {b: f for b, (_, f) in self.pointer().items() if f is not None}
        ship(self.spark)

        def maybe(bucket: pd.Series, h: pd.Series) -> pd.Series:
            out = np.zeros(len(h), bool)
            halves = _halves(h) if len(h) else np.zeros((0, 2), np.uint64)
            for b in set(bucket) & filters.keys():
                mine = np.flatnonzero(bucket.to_numpy() == b)
                bits = np.frombuffer(filters[b], np.uint8)
                at = _places(halves[mine], 8 * len(bits))
                out[mine] = ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
            return pd.Series(out)

        hit = hashes.withColumn("bucket", self.bucket()).where(F.pandas_udf(maybe, "boolean")("bucket", "content_hash"))
        return sorted(r["bucket"] for r in hit.select("bucket").distinct().collect())  # buckets at most

    def new_cards(self, cards: DataFrame) -> DataFrame:
        """Cards whose content no earlier run had, the first of each content; stored, with content_hash."""
        c = cards.withColumn("content_hash", content_hash(comparison_text()))
        fresh = c.join(self.rows(self.reached(c.select("content_hash"))).distinct(), "content_hash", "left_anti")
        return settle(first_of(fresh, F.col("content_hash")))

    def add(self, hashes: DataFrame) -> int:
        """Adds hashes: their buckets are written anew, with new filters; the version. Nothing is written where all are known."""
        ship(self.spark)
        new = settle(hashes.select("content_hash").distinct().withColumn("bucket", self.bucket()))
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # buckets at most
        if not touched:
            return self.version()
        whole = settle(new.select("content_hash").unionByName(self.rows(touched)).distinct())

        def build(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            bits = np.zeros(8 * -(-BITS * len(g) // 8), bool)
            bits[_places(_halves(g["content_hash"]), len(bits)).ravel()] = True
            return pd.DataFrame({"bucket": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

        built = whole.withColumn("bucket", self.bucket()).groupBy("bucket").applyInPandas(build, "bucket int, bits binary").collect()  # a byte for each hash of the touched buckets
        return self.replace(whole, touched, {r["bucket"]: bytes(r["bits"]) for r in built})


REGISTRY = "key string, enabled boolean, doc_type string, page_count int, last_scanned string, override_mode string"


class StoredRegistry(Bucketed):
    """The document registry as a table in buckets: a scan rewrites the buckets of the documents it saw and no others."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, schema: str = REGISTRY):
        super().__init__(spark, path, "key", schema, buckets)

    def upsert(self, scanned: DataFrame) -> int:
        """Merges a scan (key, doc_type, page_count, last_scanned); the new version."""
        scan = settle(scanned)
        touched = sorted(r["b"] for r in scan.select(self.bucket().alias("b")).distinct().collect())  # buckets at most
        return self.replace(upserted(self.rows(touched), scan), touched) if touched else self.version()
