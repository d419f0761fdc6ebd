"""Folders on a shared file system as a Spark data source, for batch and streaming reads.

    spark.dataSource.register(FolderSource)
    spark.read.format("lint_folder").option("roots", json.dumps({"repo": "/mnt/code/repo"})).load()

Partitions are folders, not roots: planning opens folders from the top until there are ``PARTS`` of them (it never lists
whole trees) and each task walks what is below its own. Filters on ``size`` and ``path`` are pushed to the tasks, which then
don't open the files. Nothing is skipped in silence: a file that can't be taken is a row with an ``error`` and no content.

A stream's offset is a time. A batch reads the files whose status changed after its start and up to its end; a file that is
rewritten comes again. Where clocks of several writers differ, ``settle`` seconds keep the end behind the clock.
"""

from __future__ import annotations

import json
import os
import time
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringEndsWith,
    StringStartsWith,
)

from lintlake import fixed_values as fv
from lintlake.sources.files import collected, decode, normalize_path

RAW_SCHEMA = "repo string, path string, raw binary, size long, error string"
#: Folders that planning aims at, and bytes of the files in one batch, about: a worker holds a batch as files and as Arrow.
PARTS = 64
BATCH_BYTES = 4 * 1024 * 1024
#: What stands in ``error``; a file with bad bytes is taken, with a mark in place of each.
TOO_LARGE, UNREADABLE, BAD_BYTES = "too large", "unreadable", "invalid bytes"


@dataclass
class Folder(InputPartition):
    """A folder of a root; ``deep``: with all folders below it. Times bound the last change, in nanoseconds."""

    repo: str
    root: str
    below: str
    deep: bool
    after: int = -1
    until: int = 2**63 - 1


def planned(roots: dict[str, str], parts: int = PARTS, after: int = -1, until: int = 2**63 - 1) -> list[Folder]:
    """Folders that together are the roots' trees: the largest known ones are opened from the top, breadth first."""
    open_, done = deque(Folder(repo, root, "", True, after, until) for repo, root in sorted(roots.items())), []
    while open_ and len(open_) + len(done) < parts:
        f = open_.popleft()
        try:
            with os.scandir(os.path.join(f.root, f.below)) as entries:
                names = sorted(e.name for e in entries if e.is_dir(follow_symlinks=False) and e.name not in fv.SKIP_DIRS)
        except OSError:  # the task reports it
            names = []
        done.append(Folder(f.repo, f.root, f.below, False, after, until))
        open_.extend(Folder(f.repo, f.root, os.path.join(f.below, n), True, after, until) for n in names)
    return [*done, *open_]


class _Rows:
    """Reads the files of a folder, as far as the pushed filters let it."""

    def __init__(self, options: dict[str, str]):
        self.roots: dict[str, str] = json.loads(options["roots"])
        self.limit = int(options.get("maxbytes", fv.MAX_FILE_BYTES))
        self.parts = int(options.get("parts", PARTS))
        self.taken: list[Filter] = []

    def wanted(self, path: str, size: int | None) -> bool:
        for f in self.taken:
            value = path if f.attribute == ("path",) else size
            if value is None:
                return False
            ok = {
                EqualTo: lambda v, f=f: v == f.value, LessThan: lambda v, f=f: v < f.value, LessThanOrEqual: lambda v, f=f: v <= f.value,
                StringStartsWith: lambda v, f=f: v.startswith(f.value), StringEndsWith: lambda v, f=f: v.endswith(f.value),
            }[type(f)]
            if not ok(value):
                return False
        return True

    def walk(self, folder: Folder) -> Iterator[tuple[str, os.stat_result | OSError]]:
        failed: list[OSError] = []
        for at, dirs, names in os.walk(os.path.join(folder.root, folder.below), onerror=failed.append):
            dirs[:] = sorted(d for d in dirs if d not in fv.SKIP_DIRS) if folder.deep else []
            for name in sorted(names):
                full = os.path.join(at, name)
                try:
                    yield full, os.stat(full)
                except OSError as error:
                    yield full, error
        for error in failed:
            yield error.filename, error

    def read(self, folder: Folder) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for full, found in self.walk(folder):
            path = os.path.relpath(full, folder.root).replace("\\", "/")
            raw, size, error = None, None, None
            if isinstance(found, OSError):
                error = UNREADABLE
            elif not folder.after < found.st_ctime_ns <= folder.until:
                continue
            else:
                size = found.st_size
            if not self.wanted(path, size):
                continue
            if error is None and size > self.limit:
                error = TOO_LARGE
            elif error is None:
                try:
                    with open(full, "rb") as handle:
                        raw = handle.read()
                except OSError:
                    error = UNREADABLE
            rows.append((folder.repo, path, raw, size, error))
            held += len(raw or b"")
            if held >= BATCH_BYTES or len(rows) >= 10_000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"repo": pa.string(), "path": pa.string(), "raw": pa.binary(), "size": pa.int64(), "error": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


class _Reader(_Rows, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of the size, and starts, ends and equality of the path, are done here; the rest is Spark's."""
        for f in filters:
            mine = getattr(f, "attribute", None)
            sizes = mine == ("size",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual))
            if sizes or mine == ("path",) and isinstance(f, (EqualTo, StringStartsWith, StringEndsWith)):
                self.taken.append(f)
            else:
                yield f

    def partitions(self) -> list[Folder]:
        return planned(self.roots, self.parts)


class _StreamReader(_Rows, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.settle = int(float(options.get("settle", 0)) * 1e9)

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - self.settle}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return planned(self.roots, self.parts, start["until"], end["until"])


class FolderSource(DataSource):
    """Options: ``roots`` (JSON, repo to folder), ``maxbytes``, ``parts``, ``settle``."""

    @classmethod
    def name(cls) -> str:
        return "lint_folder"

    def schema(self) -> str:
        return RAW_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def _source(reader, roots: dict[str, str], options: dict[str, object]):
    reader = reader.format(FolderSource.name()).option("roots", json.dumps(roots))
    return reader.options(**{k: str(v) for k, v in options.items()}).load()


def folder_rows(spark: SparkSession, roots: dict[str, str], **options: object) -> DataFrame:
    """Raw rows of the folders."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)
    return _source(spark.read, roots, options)


def folder_stream(spark: SparkSession, roots: dict[str, str], **options: object) -> DataFrame:
    """Raw rows of the folders' files as they come."""
    spark.dataSource.register(FolderSource)
    return _source(spark.readStream, roots, options)


def checked(raw: DataFrame) -> DataFrame:
    """(repo, path, content, size, error): decoded; ``error`` says why there is no content or what was replaced in it."""
    bad = F.col("raw").isNotNull() & ~F.is_valid_utf8(F.col("raw").cast("string"))
    error = F.coalesce("error", F.when(bad, F.lit(BAD_BYTES)))
    content = F.when(F.col("raw").isNotNull(), decode(F.col("raw")))
    return raw.select("repo", normalize_path(F.col("path")).alias("path"), content.alias("content"), "size", error.alias("error"))


def _counts() -> list[Column]:
    one = lambda name, kind: F.count_if(F.col("error") == kind).alias(name)
    return [F.count(F.lit(1)).alias("seen"), one("too_large", TOO_LARGE), one("unreadable", UNREADABLE), one("bad_bytes", BAD_BYTES)]


def ingest(spark: SparkSession, roots: dict[str, str], path: str, **options: object) -> dict[str, int]:
    """Read the folders once into a table at ``path``; returns what was seen and refused, observed on the way.

    ``taken`` and ``refused`` are the two outputs.
    """
    seen = Observation("ingest")
    checked(folder_rows(spark, roots, **options)).observe(seen, *_counts()).write.mode("overwrite").parquet(path)
    return seen.get


def taken(rows: DataFrame) -> DataFrame:
    """The files table of ingested rows, by the rules of collection."""
    return collected(rows.filter(F.col("content").isNotNull()).select("repo", "path", "content", "size"))


def refused(rows: DataFrame) -> DataFrame:
    """(repo, path, size, error) of the files that have no content, or not all of it."""
    return rows.filter(F.col("error").isNotNull()).select("repo", "path", "size", "error")
