"""Helpers shared by the operators: tables, intermediate tables, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside joins; larger than any real id, so a null id never represents others.
NULL_ID = 2**63 - 1
#: Rows of a few numbers that one task writes, see ``merged``.
ROWS_A_TASK = 50_000

_FOLD_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``; a local session without it gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lintlake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def merged(df: DataFrame, rows: int, each: int = ROWS_A_TASK) -> DataFrame:
    """``df``, which has about so many rows, in one task for ``each`` of them, three a core at least.

    A small table after a shuffle is otherwise a task (and a file, a Python worker) for each shuffle partition, however few
    rows that has; a large one has more rows than partitions times ``each`` and stays as it is.
    """
    return df.coalesce(max(3 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    With ``rows``, about how many it has, by as few tasks as these need.
    """
    if rows is not None:
        df = merged(df, rows)
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that only a few texts at a time become Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def map_columns(
    df: DataFrame, columns: list[str], schema: str, work: Callable[[list[pa.Array]], dict[str, object] | None]
) -> DataFrame:
    """``work`` gets the named columns of a few rows as Arrow arrays and returns the result's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = work([batch.column(i) for i in range(len(columns))])
            if out is not None:
                yield pa.RecordBatch.from_pydict(out)

    return df.select(*columns).mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def shingle_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.

    ``bytes.split`` separates at exactly those six bytes.
    """
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.

    Every byte of a character beyond ASCII is 128 or more, so the class works on UTF-8 bytes.
    """
    return text.translate(_FOLD_ALNUM).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values (wrapping arithmetic)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def row_key(*columns: str):
    """Two 64-bit hashes that name a row by its content (repeated rows share it)."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *reversed(columns)).alias("b"))
