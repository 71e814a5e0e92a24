"""Paged files as a Spark data source: read by page ranges with pushed filters, and files written whole or not at all.

    register(spark)
    spark.read.format("paged_files").option("path", folder).option("opener", "module:function").load().where("page_num <= 3")
    images.write.format("file_folder").option("path", folder).mode("overwrite").save()

An opener takes (path, content) and gives something like a list of page texts: ``len`` is the number of pages, and only
pages that are asked for are indexed. Paths are those that Arrow's file systems know (local, s3, gs, hdfs).
"""

from __future__ import annotations

import fnmatch
import importlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from leafmill.plans.ship import ship

PAGES = "path string, page_num int, raw_text string"
FILES = "filename string, content binary"


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session, and lets filters be pushed into them."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedFiles)
    spark.dataSource.register(FileFolder)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Wanted:
    """What pushed filters leave: pages first to last, and paths (None: all)."""

    first: int = 1
    last: int | None = None
    paths: set[str] | None = None

    def take(self, f: Filter) -> bool:
        """Narrows by a filter; whether nothing of it is left to check."""
        if len(f.attribute if hasattr(f, "attribute") else ()) != 1:
            return False
        column = f.attribute[0]
        if column == "path" and isinstance(f, EqualTo | In):
            some = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.paths = some if self.paths is None else self.paths & some
            return True
        if column == "page_num" and isinstance(f, EqualTo | In):
            pages = [f.value] if isinstance(f, EqualTo) else [v for v in f.value if v is not None]
            self._between(min(pages, default=1), max(pages, default=0))
            return isinstance(f, EqualTo)
        if column == "page_num" and isinstance(f, GreaterThan | GreaterThanOrEqual):
            self._between(f.value + isinstance(f, GreaterThan), None)
            return True
        if column == "page_num" and isinstance(f, LessThan | LessThanOrEqual):
            self._between(1, f.value - isinstance(f, LessThan))
            return True
        return False

    def _between(self, first: int, last: int | None) -> None:
        self.first = max(self.first, first)
        if last is not None:
            self.last = last if self.last is None else min(self.last, last)


@dataclass
class Part(InputPartition):
    """Files of a task; of a large file the ``part``-th of ``parts`` equal ranges of its pages."""

    files: list[tuple[str, int, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(None)


class PagedFiles(DataSource):
    """Pages of the files under ``path`` whose names match ``pattern``, by ``opener``. Files go into partitions of about
    ``partition_bytes``; a larger file is read by several tasks, each a range of its pages. A file that can't be read has none."""

    @classmethod
    def name(cls) -> str:
        return "paged_files"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(dict(self.options))


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern, self.opener = options["path"], options.get("pattern", "*"), options["opener"]
        self.most, self.rows = int(options.get("partition_bytes", 64 << 20)), int(options.get("batch_rows", 1024))
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the name is Spark's
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Part]:
        system, root = opened(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        parts, open_, size = [], [], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern)), key=lambda f: f.path):
            if self.wanted.paths is not None and f.path not in self.wanted.paths:
                continue
            n = max(1, -(-f.size // self.most))
            if n > 1:
                parts += [Part([(f.path, k, n)]) for k in range(n)]
                continue
            if open_ and size + f.size > self.most:
                parts.append(Part(open_))
                open_, size = [], 0
            open_.append((f.path, 0, 1))
            size += f.size
        return [*parts, *([Part(open_)] if open_ else [])] or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        module, _, function = self.opener.partition(":")
        opener = getattr(importlib.import_module(module), function)
        system, _ = opened(self.path)
        kinds = pa.schema([("path", pa.string()), ("page_num", pa.int32()), ("raw_text", pa.string())])
        rows: list[tuple[str, int, str | None]] = []
        for path, part, parts in partition.files:
            try:
                with system.open_input_file(path) as f:
                    pages = opener(path, f.read())
                n = len(pages)
            except Exception:  # noqa: BLE001  one bad file must not end the scan
                continue
            first, last = part * n // parts + 1, (part + 1) * n // parts
            for number in range(max(first, self.wanted.first), min(last, last if self.wanted.last is None else self.wanted.last) + 1):
                rows.append((path, number, pages[number - 1]))
                if len(rows) >= self.rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class FileFolder(DataSource):
    """Rows (filename, content) as files of one folder. Tasks write into folders of their own beside it; the commit keeps those of
    the tasks that count and renames the whole into place, so readers see all files or none. Appending isn't possible: a
    folder that is there is replaced (``overwrite``) or an error."""

    @classmethod
    def name(cls) -> str:
        return "file_folder"

    def schema(self) -> str:
        return FILES

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FolderWriter(self.options["path"].rstrip("/"), overwrite)


class FolderWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staging = f"{path}._writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.staging)
        folder, names = uuid.uuid4().hex, []  # of this attempt; one that is lost leaves a folder that no commit names
        system.create_dir(f"{root}/{folder}", recursive=True)
        for b in iterator:
            for name, content in zip(b.column("filename").to_pylist(), b.column("content")):
                if not name or os.path.basename(name) != name:
                    raise ValueError(f"no file name: {name!r}")
                with system.open_output_stream(f"{root}/{folder}/{name}") as f:
                    f.write(content.as_py() or b"")
                names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.staging)
        _, path = opened(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have one file name")
        if system.get_file_info(path).type != fs.FileType.NotFound and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} is there already")
        ready = f"{root}/ready"
        system.create_dir(ready, recursive=True)
        for m in done:
            for n in m.names:
                system.move(f"{root}/{m.folder}/{n}", f"{ready}/{n}")
        if system.get_file_info(path).type != fs.FileType.NotFound:
            system.move(path, f"{root}/replaced")
        system.move(ready, path)
        system.delete_dir(root)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.staging)
        if system.get_file_info(root).type != fs.FileType.NotFound:
            system.delete_dir(root)
