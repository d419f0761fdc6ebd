"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm import common

#: log2 of the number of hashed features.
BITS = 20
#: Labelled rows that the model is fitted on, at most (the rows with the smallest hash of doc_id).
MAX_ROWS = 24_000
#: Rows in one part of the sample, about; parts are fitted side by side and their weights averaged.
SHARD_ROWS = 6_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.0
STEMS = (4, 5, 6)
_STRIP = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def features(text: bytes) -> np.ndarray:
    """Hashed words, word stems, word pairs, and pairs with one or two words skipped between them (with repeats).

    A stem is a word's first four, five or six bytes: it carries what was learnt to inflected and compound forms.
    """
    strip = _STRIP
    words = [w.strip(strip) for w in text.lower().split()]
    h = np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words))
    parts = [h]
    for n in STEMS:
        cut = np.fromiter((crc32(w[:n]) for w in words), dtype=np.uint64, count=len(words))
        parts.append(cut[cut != h] + np.uint64(n << 40))
    for gap in (1, 2, 3):
        if len(h) > gap:
            parts.append(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(gap))
    return (common.mix64(np.concatenate(parts)) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal state: the sums z and n; weights follow from them."""

    def __init__(self) -> None:
        self.z = np.zeros(1 << BITS)
        self.n = np.zeros(1 << BITS)
        self.bias = 0.0
        self.bias_n = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        rate = (BETA + np.sqrt(self.n[at])) / ALPHA + L2
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / rate)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + self.bias, -35, 35)))
        g = p - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        self.bias_n += g * g
        self.bias -= ALPHA * g / (BETA + np.sqrt(self.bias_n))


class Model:
    """Sparse weights; a score is the logistic of the bias and the weights of the distinct features."""

    def __init__(self, at: np.ndarray, weight: np.ndarray, bias: float, learnt: bool = True):
        self.at, self.weight, self.bias, self.learnt = at, weight, bias, learnt
        self._dense: np.ndarray | None = None

    def __getstate__(self):
        return {"at": self.at, "weight": self.weight, "bias": self.bias, "learnt": self.learnt, "_dense": None}

    def score(self, text: bytes) -> float:
        if self._dense is None:
            self._dense = np.zeros(1 << BITS, dtype=np.float32)
            self._dense[self.at] = self.weight
        at = features(text)
        at = at[self._dense[at] != 0]
        total = self.bias + float(self._dense[np.unique(at)].sum(dtype=np.float64)) if len(at) else self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def _fit_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [
        (np.unique(features(text)).astype(np.int32), label)
        for batch in common.slices(batches)
        for text, label in zip(common.as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True)
    ]
    if not rows:
        return
    model, order = Ftrl(), np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            model.learn(*rows[i])
    at = np.flatnonzero(np.abs(model.z) > L1)
    yield pa.RecordBatch.from_pydict({
        "at": pa.array(np.append(at, -1), pa.int64()),
        "weight": pa.array(np.append(model.weights(at), model.bias), pa.float64()),
    })


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on the labelled rows that are not held out, on at most about ``max_rows`` of them.

    The sample is a hash threshold on doc_id, so it is the same for any partitioning. Rows with a null label or id are
    not used, several labels of a document count as toxic where one is. Shards are fitted side by side and the weights
    averaged; the driver gets nonzero weights only, which ``BITS`` bounds. Without any labelled row the
    model is its bias 0.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    )
    n = known.count()
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    rows = documents.select(F.col("doc_id").alias("id"), "text").join(known, F.col("id") == F.col("doc_id"))
    parts = max(1, -(-min(n, max_rows) // SHARD_ROWS))
    shard = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(parts)).alias("shard")
    weights = (
        rows.select(shard, "id", "text", "toxic")
        .repartition(parts, "shard").sortWithinPartitions("shard", "id", "text")
        .select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
        .mapInArrow(_fit_shard, "at long, weight double")
        .groupBy("at").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    )
    found = weights.toPandas()
    if found.empty:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, learnt=False)
    shards = int(found.loc[found["at"] == -1, "n"].iloc[0])
    bias = float(found.loc[found["at"] == -1, "weight"].iloc[0]) / shards
    found = found[found["at"] >= 0]
    return Model(found["at"].to_numpy(), found["weight"].to_numpy() / shards, bias)


def scores(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (null text as empty) and predicted for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def work(columns: list[pa.Array]) -> dict[str, object]:
        got = [shared.value.score(text) for text in common.as_bytes(columns[1])]
        return {
            "doc_id": columns[0], "score": pa.array(got, pa.float64()),
            "predicted": pa.array([int(x >= 0.5) for x in got], pa.int32()),
        }

    return common.map_columns(documents, ["doc_id", "text"], "doc_id long, score double, predicted int", work)


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its score; documents with a null id count as not held out."""
    got = scores(documents, fit(documents, labels))
    return got.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below 0.5, all columns as they were; without any labelled document nothing is rejected."""
    model = fit(documents, labels)
    if not model.learnt:
        return documents
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [shared.value.score(text) < 0.5 for text in common.as_bytes(batch.column(at))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
