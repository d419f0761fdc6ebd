"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over training windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm import common

WINDOW = 13
#: Text bytes of the items that one broadcast index covers; a larger benchmark is worked off in several blocks.
BLOCK_BYTES = 32 * 1024 * 1024
_BASE = np.uint64(0x9E3779B97F4A7C15)
_HITS = "doc_id long, row_a long, row_b long, n_words long, hits array<int>, items array<string>"


class WindowIndex:
    """Windows of some items: word numbers, and for each window length a sorted array of window hashes."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.words: dict[bytes, int] = {}
        self.items_of: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item_id, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in common.alnum_words(text)]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                self.items_of.setdefault(n, {}).setdefault(tuple(ids[i : i + n]), set()).add(item_id)
        self.hashes = {
            n: np.unique(_rolling(np.array(list(found), dtype=np.uint64).reshape(-1), n)[::n])
            for n, found in self.items_of.items()
        }

    def scan(self, words: list[bytes]) -> tuple[list[int], list[str]]:
        """Positions of the words inside occurrences, and the items they come from."""
        number = self.words.get
        ids = np.array([number(w, 0) for w in words], dtype=np.uint64)
        hit, items = np.zeros(len(ids), dtype=bool), set()
        for n, hashes in self.hashes.items():
            if len(ids) < n:
                continue
            known = np.concatenate(([0], np.cumsum(ids > 0)))
            starts = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(starts):
                continue
            got = _rolling(ids, n)[starts]
            at = np.searchsorted(hashes, got)
            starts = starts[hashes[np.minimum(at, len(hashes) - 1)] == got]
            for i in starts.tolist():
                found = self.items_of[n].get(tuple(ids[i : i + n].tolist()))
                if found:
                    hit[i : i + n] = True
                    items |= found
        return np.flatnonzero(hit).tolist(), sorted(items)


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` numbers."""
    if len(ids) < n:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    for k in range(n):
        total = total * _BASE + ids[k : k + len(total)]
    return common.mix64(total)


def _size(benchmark: DataFrame) -> int:
    return benchmark.agg(F.sum(F.length(F.col("text").cast("binary")) + F.lit(64))).first()[0] or 0


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks that are small enough for the driver and a broadcast."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("body")
    ).filter(F.col("body").isNotNull())
    n = -(-_size(benchmark) // block_bytes)
    for b in range(n):
        part = items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(n)) == b)
        yield [(r.item, bytes(r.body)) for r in part.toLocalIterator()]


def _row() -> list[Column]:
    """Two hashes that name a row by its id and text."""
    return [F.xxhash64("doc_id", "text").alias("row_a"), F.xxhash64("text", "doc_id").alias("row_b")]


def benchmark_hits(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per document: number of words, positions of hit words, items with occurring windows.

    Each block of the benchmark is one pass over the documents; the usual benchmark is one block. A null text has
    no words. A null item_id counts as the item ''. Rows that repeat a document are merged in the blocked case only
    after all of them were scanned, so each keeps the same figures.
    """
    return _row_hits(documents, benchmark, window, block_bytes).drop("row_a", "row_b")


def _row_hits(documents: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """The hits with the hashes that name the row."""
    spark = documents.sparkSession
    keyed = documents.select("doc_id", *_row(), "text")

    def scanned(index) -> DataFrame:
        def work(columns: list[pa.Array]) -> dict[str, object]:
            n_words, hits, items = [], [], []
            for text in common.as_bytes(columns[3]):
                words = common.alnum_words(text)
                h, i = index.value.scan(words) if index else ([], [])
                n_words.append(len(words))
                hits.append(h)
                items.append(i)
            return {
                "doc_id": columns[0], "row_a": columns[1], "row_b": columns[2], "n_words": pa.array(n_words, pa.int64()),
                "hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string())),
            }

        return common.map_columns(keyed, ["doc_id", "row_a", "row_b", "text"], _HITS, work)

    parts = [
        scanned(spark.sparkContext.broadcast(WindowIndex(block, window))) for block in _blocks(benchmark, block_bytes)
    ]
    if len(parts) <= 1:
        return parts[0] if parts else scanned(None)
    merged = parts[0]
    for more in parts[1:]:
        one = more.groupBy("row_a", "row_b").agg(F.first("hits").alias("h"), F.first("items").alias("i"))
        merged = merged.join(one, ["row_a", "row_b"]).select(
            "doc_id", "row_a", "row_b", "n_words",
            F.array_sort(F.array_union("hits", "h")).alias("hits"), F.array_union("items", "i").alias("items"),
        )
    return merged


def _contaminated() -> Column:
    n_hit = F.size("hits").cast("long")
    return (n_hit > 0) & (20 * n_hit >= F.col("n_words"))


def contamination(hits: DataFrame) -> DataFrame:
    """The counts and the verdict of each document; hit words are at least a twentieth where it is contaminated."""
    n_hit = F.size("hits").cast("long")
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        _contaminated().alias("contaminated"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without the contaminated ones, all columns as they were (a document without words stays).

    A benchmark of one block is a filter inside the scan. With several blocks the verdict needs the hits of all of
    them, and the contaminated rows are named by their content.
    """
    blocks = list(_blocks(benchmark, block_bytes)) if _size(benchmark) <= block_bytes else None
    if blocks is not None:
        if not blocks:
            return documents
        index = documents.sparkSession.sparkContext.broadcast(WindowIndex(blocks[0], WINDOW))
        at = documents.columns.index("text")

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = []
                for text in common.as_bytes(batch.column(at)):
                    words = common.alnum_words(text)
                    n_hit = len(index.value.scan(words)[0])
                    clean.append(not (n_hit and 20 * n_hit >= len(words)))
                yield batch.filter(pa.array(clean, pa.bool_()))

        return documents.mapInArrow(keep, documents.schema)
    bad = _row_hits(documents, benchmark, WINDOW, block_bytes).filter(_contaminated())
    bad = bad.select(F.col("row_a").alias("bad_a"), F.col("row_b").alias("bad_b")).distinct()
    packed = documents.select(F.struct(*documents.columns).alias("doc"), *_row())
    kept = packed.join(bad, (F.col("row_a") == F.col("bad_a")) & (F.col("row_b") == F.col("bad_b")), "left_anti")
    return kept.select(*[F.col(f"doc.{c}") for c in documents.columns])
