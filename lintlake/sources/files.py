"""The ``files`` table: directory ingest and the collection rules.

Rules that need only ``path`` and ``size`` are plain predicates, so on a columnar table they are
pushed to the scan and rejected rows never decode their ``content``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions import text

FILES_SCHEMA = "repo string, path string, content string, size long"
_LISTING_SCHEMA = "repo string, root string, path string, size long"
_RAW_SCHEMA = "repo string, path string, raw binary, size long"
_LISTING_ROWS = 2_000
_READ_BYTES = 32 * 1024 * 1024


def has_collected_name(path: Column) -> Column:
    name = text.basename(path)
    return F.lower(text.suffix(path)).isin(fv.CODE_SUFFIXES) | name.startswith(".")


def outside_skipped_dirs(path: Column) -> Column:
    parts = F.split(path, "/", -1)
    dirs = F.slice(parts, F.lit(1), F.size(parts) - F.lit(1))
    return ~F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in fv.SKIP_DIRS]))


def within_size(size: Column, limit: int = fv.MAX_FILE_BYTES) -> Column:
    return size <= F.lit(limit)


def normalize_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def decode(raw: Column) -> Column:
    """UTF-8 with U+FFFD for bad bytes, then universal newlines."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\r\n?", "\n")


def collected(files: DataFrame) -> DataFrame:
    """The rows of a files table that collection keeps, with normalized paths."""
    path = normalize_path(F.col("path"))
    return (
        files.filter(within_size(F.col("size")))
        .filter(has_collected_name(path))
        .filter(outside_skipped_dirs(path))
        .withColumn("path", path)
    )


def read_directories(spark: SparkSession, roots: DataFrame, parallelism: int | None = None) -> DataFrame:
    """``roots(repo, root)`` on a shared file system -> files table.

    Two steps: list names and sizes, then spread the surviving paths evenly over tasks and read them,
    so a huge repository is read by many tasks. ``binaryFile`` is not used because it hides
    names that begin with a dot or an underscore.
    """
    tasks = parallelism or int(spark.conf.get("spark.sql.shuffle.partitions"))
    listing = roots.select("repo", "root").repartition(tasks, "root").mapInPandas(_list_files, _LISTING_SCHEMA)
    wanted = listing.filter(within_size(F.col("size"))).filter(has_collected_name(F.col("path")))
    raw = wanted.repartition(tasks, "repo", "path").mapInPandas(_read_files, _RAW_SCHEMA)
    return raw.select("repo", normalize_path(F.col("path")).alias("path"),
                      decode(F.col("raw")).alias("content"), "size")


def _list_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    skip = set(fv.SKIP_DIRS)
    rows: list[tuple] = []
    for batch in batches:
        for repo, root in zip(batch["repo"], batch["root"]):
            for folder, dirs, names in os.walk(root):
                dirs[:] = [d for d in dirs if d not in skip]
                for name in names:
                    full = os.path.join(folder, name)
                    try:
                        size = os.stat(full).st_size
                    except OSError:
                        continue
                    rows.append((repo, root, os.path.relpath(full, root), size))
                    if len(rows) >= _LISTING_ROWS:
                        yield pd.DataFrame(rows, columns=["repo", "root", "path", "size"])
                        rows = []
    yield pd.DataFrame(rows, columns=["repo", "root", "path", "size"])


def _read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for repo, root, path, size in batch[["repo", "root", "path", "size"]].itertuples(index=False):
            try:
                with open(os.path.join(root, path), "rb") as handle:
                    raw = handle.read()
            except OSError:
                continue
            rows.append((repo, path, raw, size))
            held += len(raw)
            if held >= _READ_BYTES:
                yield pd.DataFrame(rows, columns=["repo", "path", "raw", "size"])
                rows, held = [], 0
    yield pd.DataFrame(rows, columns=["repo", "path", "raw", "size"])
