"""Removal of repeated 200-byte strings by a sample of suffixes that is chosen by content, in the manner of a difference cover.

A difference cover is a sample of positions such that two equal strings always meet the sample at the same distance.
Residues modulo 3 are one; here the sample is chosen by content: in every 200-byte window, the first of its byte
``GRAM``-grams with the smallest hash. Equal windows have the same sampled position at the same distance, and there is one sample in
about 70 bytes instead of two in three. The steps are those of the difference-cover algorithm:

* sample: each sampled position stands for the run of windows that it was chosen in (a unit). Its triple is what lies
  before it, its gram, and what lies behind it, as far as its windows reach;
* sort the sampled triples over the whole cluster and compare neighbours: with an equal triple beside it every window
  of the unit is repeated, without an equal gram beside it none is. Only 200 bytes of a suffix count and a triple reaches as far, so names
  need no further recursion;
* merge the remaining suffixes, those of units whose gram is repeated in another context: a suffix is
  named by what lies between its start and the sampled position and by the name of what follows, and equal names are repeats.

Names are 128-bit hashes (a gram's and a triple's or window's), so equality stands for equality of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm import common

LENGTH = 200
GRAM = 24
#: Bytes of a text that are sampled at once.
SEGMENT = 1 << 20
#: Remaining units of one gram that are merged inside one task; the windows of more frequent grams are counted as rows.
MERGE_UNITS = 20_000

_POSITION = np.uint64(SEGMENT * 2 - 1)
_CONSTANTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_UNIT = "g long, u long, doc_id long, h long, start int, n int, at int"
_LABELLED = _UNIT + ", label int, part int, inner_u boolean, inner_g boolean"
_DUP, _OPEN, _EDGE, _WITNESS = 1, 2, 3, 4


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Hashes of substrings of one byte string, from sums over its 8-grams."""

    _up = _powers(int(_CONSTANTS[0]), SEGMENT * 2)
    _down = _powers(pow(int(_CONSTANTS[0]), -1, 2**64), SEGMENT * 2)

    def __init__(self, text: bytes | np.ndarray):
        h = np.frombuffer(text, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        for n, m in zip((1, 2, 4), _CONSTANTS, strict=False):
            h = h[:-n] * m + h[n:]
        self.eights = common.mix64(h)
        self.sums = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(self.eights * self._up[: len(h)], out=self.sums[1:])

    def grams(self) -> np.ndarray:
        h = self.eights
        sixteen = h[:-8] * _CONSTANTS[3] + h[8:]
        return common.mix64(sixteen[:-8] * _CONSTANTS[4] + h[16:])

    def between(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the bytes from ``start`` to ``stop`` (eight or more)."""
        return common.mix64((self.sums[stop - 7] - self.sums[start]) * self._down[start] + (stop - start).astype(np.uint64))


def sampled_units(text: bytes) -> list[tuple[np.ndarray, ...]]:
    """Per segment: (start, windows, sampled position, gram hash, triple hash) of the units of a text."""
    out = []
    for base in range(0, len(text) - LENGTH + 1, SEGMENT):
        part = text[base : base + SEGMENT + LENGTH - 1]
        hasher = Hasher(part)
        grams = hasher.grams()
        # The smallest hash wins, among equal ones the first: position in the low bits.
        low = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        width, reach = LENGTH - GRAM + 1, 1
        while 2 * reach <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        n = len(part) - LENGTH + 1
        low = np.minimum(low[:n], low[width - reach : width - reach + n])
        start = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        windows = np.diff(np.append(start, n))
        at = (low[start] & _POSITION).astype(np.int64)
        triple = hasher.between(start, start + windows + LENGTH - 1) + (at - start).astype(np.uint64)
        out.append((start + base, windows, at + base, grams[at], common.mix64(triple)))
    return out


def _units(texts: DataFrame) -> DataFrame:
    def work(columns: list[pa.Array]) -> dict[str, object]:
        found, doc, h = [], [], []
        for doc_id, text_hash, text in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2].to_pylist(), strict=True):
            for part in sampled_units(text):
                found.append(part)
                doc.append(np.full(len(part[0]), doc_id))
                h.append(np.full(len(part[0]), text_hash, dtype=np.int64))
        if not found:
            return None
        start, windows, at, gram, triple = (np.concatenate(x) for x in zip(*found, strict=True))
        return {
            "g": pa.array(gram.view(np.int64)), "u": pa.array(triple.view(np.int64)), "doc_id": pa.array(np.concatenate(doc)),
            "h": pa.array(np.concatenate(h)), "start": pa.array(start.astype(np.int32)), "n": pa.array(windows.astype(np.int32)),
            "at": pa.array(at.astype(np.int32)),
        }

    return common.map_columns(texts, ["doc_id", "h", "body"], _UNIT, work)


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label sorted units by their neighbours; the first and the last of a partition are left to ``_edges``."""
    part, held, before, first = TaskContext.get().partitionId(), None, (False, False), True

    def labelled(batch: pa.RecordBatch, label: np.ndarray, inner: tuple[bool, bool]) -> pa.RecordBatch:
        keep = pa.array(label > 0)
        n = batch.num_rows
        columns = [*batch.columns, pa.array(label.astype(np.int32)), pa.array(np.full(n, part, dtype=np.int32))]
        columns += [pa.array(np.full(n, x)) for x in inner]
        names = [*batch.schema.names, "label", "part", "inner_u", "inner_g"]
        return pa.RecordBatch.from_arrays(columns, names=names).filter(keep)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_batches([held, batch]) if held is not None else batch
        g, u = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        same_g = g[1:] == g[:-1]
        same_u = same_g & (u[1:] == u[:-1])
        up_u, up_g = np.append([before[0]], same_u), np.append([before[1]], same_g)
        other = (up_g & ~up_u)[:-1] | (same_g & ~same_u)
        label = np.where(up_u[:-1] | same_u, np.where(other, _WITNESS, _DUP), np.where(other, _OPEN, 0))
        done = rows.slice(0, len(label))
        if first and len(label):
            yield labelled(done.slice(0, 1), np.array([_EDGE]), (bool(same_u[0]), bool(same_g[0])))
            done, label, first = done.slice(1), label[1:], False
        if len(label):
            yield labelled(done, label, (False, False))
        held, before = rows.slice(rows.num_rows - 1), (bool(up_u[-1]), bool(up_g[-1]))
    if held is not None:
        yield labelled(held, np.array([_EDGE]), before)


def _edges(rows: list) -> list[tuple]:
    """Labels of the first and last units of all partitions (a few rows per partition)."""
    rows = sorted(rows, key=lambda r: (r.part, r.g, r.u))
    out = []
    for i, r in enumerate(rows):
        near = [x for x in (rows[i - 1] if i else None, rows[i + 1] if i + 1 < len(rows) else None) if x and x.part != r.part]
        equal = r.inner_u or any((x.g, x.u) == (r.g, r.u) for x in near)
        other = (r.inner_g and not r.inner_u) or any(x.g == r.g and x.u != r.u for x in near)
        if equal or other:
            label = (_WITNESS if other else _DUP) if equal else _OPEN
            out.append((r.doc_id, r.h, r.start, r.n, r.at, r.g, label))
    return out


def _labelled_units(texts: DataFrame) -> DataFrame:
    """Units that are repeated as a whole (_DUP) or whose gram is repeated only in other triples (_OPEN).

    Of equal units beside other triples of their gram one or two are _WITNESS: repeated, and also needed in the merge.
    """
    ordered = _units(texts).repartitionByRange("g", "u", "doc_id", "start").sortWithinPartitions("g", "u", "doc_id", "start")
    all_rows = common.stored(ordered.mapInArrow(_compare_neighbours, _LABELLED))
    edges = _edges(all_rows.filter(F.col("label") == _EDGE).collect())
    columns = ["doc_id", "h", "start", "n", "at", "g", "label"]
    rest = all_rows.filter(F.col("label") != _EDGE).select(*columns)
    resolved = texts.sparkSession.createDataFrame(edges, "doc_id long, h long, start int, n int, at int, g long, label int")
    return rest.unionByName(resolved)


def cover(length: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which bytes the spans (start, stop) cover."""
    change = np.zeros(length + 1, dtype=np.int32)
    for start, stop in spans:
        change[start] += 1
        change[stop] -= 1
    return np.cumsum(change[:-1]) > 0


def _figures(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, bytes]:
    gone = cover(len(text), spans)
    kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if spans else text
    runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(gone) else 0
    return len(text), len(text) - len(kept), runs, kept


_DONE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_HALF = _DONE + ", h long, body binary, spans array<struct<a:int,b:int>>, open array<struct<g:long,start:int,n:int,at:int>>"
_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_OPENS = pa.list_(pa.struct([("g", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("at", pa.int32())]))


def _result(doc, h, text, spans, opens) -> dict[str, object]:
    figures = [_figures(t, s) if not o else (len(t), None, None, None) for t, s, o in zip(text, spans, opens, strict=True)]
    return {
        "doc_id": pa.array(doc, pa.int64()), "n_bytes": pa.array([f[0] for f in figures], pa.int64()),
        "n_removed": pa.array([f[1] for f in figures], pa.int64()), "n_spans": pa.array([f[2] for f in figures], pa.int64()),
        "kept_sha256": pa.array([None if f[3] is None else sha256(f[3]).hexdigest() for f in figures], pa.string()),
        "h": pa.array(h, pa.int64()), "body": pa.array([t if o else None for t, o in zip(text, opens, strict=True)], pa.binary()),
        "spans": pa.array([[{"a": a, "b": b} for a, b in s] if o else None for s, o in zip(spans, opens, strict=True)], _SPANS),
        "open": pa.array([o or None for o in opens], _OPENS),
    }


def _first_figures(texts: DataFrame, labelled: DataFrame) -> DataFrame:
    """Documents without remaining units are finished; the others keep their text for the merge."""
    per_text = labelled.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "n", "at", "label", "g")).alias("units"))
    joined = texts.join(per_text, ["doc_id", "h"], "left").select("doc_id", "h", "body", "units")

    def work(columns: list[pa.Array]) -> dict[str, object]:
        doc, h, text = (c.to_pylist() for c in columns[:3])
        spans, opens = [], []
        for units in columns[3].to_pylist():
            units = units or []
            spans.append([(x["start"], x["start"] + x["n"] + LENGTH - 1) for x in units if x["label"] != _OPEN])
            opens.append([{k: x[k] for k in ("g", "start", "n", "at")} for x in units if x["label"] != _DUP])
        return _result(doc, h, text, spans, opens)

    return common.stored(common.map_columns(joined, ["doc_id", "h", "body", "units"], _HALF, work))


def _pieces(half: DataFrame) -> DataFrame:
    """The bytes that the windows of each remaining unit reach."""
    one = half.filter("open IS NOT NULL").select("doc_id", "h", "body", F.explode(F.array_distinct("open")).alias("o"))
    piece = F.substring(F.col("body"), F.col("o.start") + 1, F.col("o.n") + F.lit(LENGTH - 1))
    return one.select("o.g", "doc_id", "h", "o.start", "o.n", (F.col("o.at") - F.col("o.start")).alias("at"), piece.alias("piece"))


def _window_names(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, name) of every window of the pieces; a name also holds the gram and the distance to it."""
    g, n, at = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("g", "n", "at"))
    rows, offsets, names = [], [], []
    pieces = batch.column(batch.schema.get_field_index("piece")).to_pylist()
    lengths = np.array([len(p) for p in pieces])
    group = (np.cumsum(lengths) - lengths) // SEGMENT  # so many bytes are hashed at once
    for k in range(int(group[-1]) + 1 if len(group) else 0):
        mine = np.flatnonzero(group == k)
        if not len(mine):
            continue
        hasher = Hasher(b"".join(pieces[i] for i in mine))
        begin = np.cumsum(lengths[mine]) - lengths[mine]
        row = np.repeat(np.arange(len(mine)), n[mine])
        offset = np.arange(len(row)) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine])
        start = begin[row] + offset
        name = hasher.between(start, start + LENGTH)
        row = mine[row]
        names.append(common.mix64(name + g[row].view(np.uint64) * _CONSTANTS[1] + (at[row] - offset).astype(np.uint64) * _CONSTANTS[2]))
        rows.append(row)
        offsets.append(offset)
    if not rows:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    return np.concatenate(rows), np.concatenate(offsets), np.concatenate(names)


def _runs(batch: pa.RecordBatch, row: np.ndarray, offset: np.ndarray) -> dict[str, object]:
    """Spans of neighbouring windows; the windows are in order."""
    if not len(row):
        return {}
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(row)) - 1
    take = pa.array(row[begin])
    start = batch.column(batch.schema.get_field_index("start")).to_numpy()[row[begin]]
    return {
        "doc_id": batch.column(batch.schema.get_field_index("doc_id")).take(take),
        "h": batch.column(batch.schema.get_field_index("h")).take(take),
        "a": pa.array((start + offset[begin]).astype(np.int32)), "b": pa.array((start + offset[end] + LENGTH).astype(np.int32)),
    }


def _merge(pieces: DataFrame) -> DataFrame:
    """Spans of the repeated windows of the remaining units."""
    many = pieces.groupBy("g").agg(F.count(F.lit(1)).alias("units")).filter(F.col("units") > MERGE_UNITS).select("g")
    many = common.stored(many)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.concat_batches([*kept, batch]) if kept else batch
            changed = np.flatnonzero(np.diff(whole.column(0).to_numpy()))
            cut = int(changed[-1]) + 1 if len(changed) else 0
            if cut:
                yield from repeated(whole.slice(0, cut))
            kept = [whole.slice(cut)]
        if kept:
            yield from repeated(kept[0])

    def repeated(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, offset, name = _window_names(batch)
        order = np.argsort(name, kind="stable")
        same = name[order][1:] == name[order][:-1]
        hit = np.zeros(len(name), dtype=bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        found = _runs(batch, row[hit], offset[hit])
        if found:
            yield pa.RecordBatch.from_pydict(found)

    usual = pieces.join(many, "g", "left_anti").repartition("g").sortWithinPartitions("g")
    usual = usual.select("g", "doc_id", "h", "start", "n", "at", "piece").mapInArrow(inside, "doc_id long, h long, a int, b int")
    if many.isEmpty():
        return usual

    def windows(columns: list[pa.Array]) -> dict[str, object]:
        batch = pa.RecordBatch.from_arrays(columns, names=["g", "doc_id", "h", "start", "n", "at", "piece"])
        row, offset, name = _window_names(batch)
        take = pa.array(row)
        a = columns[3].to_numpy()[row] + offset
        return {
            "g": columns[0].take(take), "name": pa.array(name.view(np.int64)), "doc_id": columns[1].take(take),
            "h": columns[2].take(take), "a": pa.array(a.astype(np.int32)), "b": pa.array((a + LENGTH).astype(np.int32)),
        }

    rows = common.map_columns(
        pieces.join(many, "g", "left_semi"), ["g", "doc_id", "h", "start", "n", "at", "piece"],
        "g long, name long, doc_id long, h long, a int, b int", windows,
    )
    often = rows.groupBy("g", "name").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("g", "name")
    return usual.unionByName(rows.join(often, ["g", "name"], "left_semi").select("doc_id", "h", "a", "b"))


def without_repeats(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty; texts under 200 bytes lose nothing. Rows that repeat a document are copies of each other, so
    they lose every byte if they have 200. All 200-byte strings are judged on the input. A text is named by its id and
    64 bits of its hash, so texts that share an id, or have none, are each judged by themselves.
    """
    body = F.coalesce("text", F.lit(""))
    texts = documents.select(
        F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("doc_id"), F.xxhash64(body).alias("h"), body.cast("binary").alias("body")
    )
    half = _first_figures(texts, _labelled_units(texts))
    spans = _merge(_pieces(half)).groupBy("doc_id", "h").agg(F.collect_set(F.struct("a", "b")).alias("more"))
    waiting = half.filter("open IS NOT NULL").select("doc_id", "h", "body", "spans")
    joined = waiting.join(spans, ["doc_id", "h"], "left")

    def work(columns: list[pa.Array]) -> dict[str, object]:
        doc, h, text = (c.to_pylist() for c in columns[:3])
        both = [
            [(x["a"], x["b"]) for x in (first or []) + (more or [])]
            for first, more in zip(columns[3].to_pylist(), columns[4].to_pylist(), strict=True)
        ]
        got = _result(doc, h, text, both, [[]] * len(doc))
        return {c: got[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}

    finished = common.map_columns(joined, ["doc_id", "h", "body", "spans", "more"], _DONE, work)
    done = half.filter("open IS NULL").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return done.unionByName(finished).withColumn("doc_id", F.when(F.col("doc_id") != common.NULL_ID, F.col("doc_id")))
