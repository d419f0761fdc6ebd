"""Maximal periodic runs of words, found with string synchronising sets.

Words of many documents lie in one array, as numbers that are equal only for equal words of one document, with a word
that equals nothing after each document, so no run crosses two documents. Names of all stretches of 2**k words are made
by doubling; they are exact, and stretches that occur once share the name -1, which equals nothing.

At the scale t = 2, 4, 8, ... a position belongs to the synchronising set if, of the t + 1 stretches of t words that start
at it and after it, one with the least hash starts at its first or last place; stretches whose period is at most t / 3
don't take part. The choice depends only on the 2t words at the position, every t positions in a row hold a chosen one unless
the region is highly periodic, and chosen positions with equal words are more than t / 3 apart. So a run with a period q of 4t
to 8t has a chosen position whose 2t words return q later: pairs of equal contexts propose the period, and common
extensions to both sides give the run. What the sets omit comes from the highly periodic regions, found separately: runs
with periods under 8 by direct comparison, and runs whose first period lies inside such a region (the next one then lies
inside another one with the same small period that touches it) from the alignments of the two regions.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm import common

#: Least number of words of a run.
SHORTEST = 12
#: Words that are looked at together (documents are never cut).
CHUNK = 200_000
#: Periods below are compared directly.
SMALL = 8
_NEVER = np.uint64(2**64 - 1)
_RUNS = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _names(ids: np.ndarray) -> list[np.ndarray]:
    """names[k][i] of the 2**k words from i on; -1 where they occur once. One more -1 stands at the end."""
    n = len(ids)
    seen = np.bincount(ids[ids >= 0], minlength=1)
    levels = [np.append(np.where((ids >= 0) & (seen[ids] > 1), ids, -1), -1)]
    while (1 << len(levels)) <= n:
        below, half = levels[-1], 1 << (len(levels) - 1)
        at = np.flatnonzero((below[: n - half] >= 0) & (below[half:n] >= 0))
        if not len(at):
            break
        _, name, times = np.unique(below[at] * np.int64(n + 1) + below[at + half], return_inverse=True, return_counts=True)
        again = times[name] > 1
        if not again.any():
            break
        level = np.full(n + 1, -1, dtype=np.int64)
        level[at[again]] = name[again]
        levels.append(level)
    return levels


def _extended(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words after (from i and j on) and before (i - 1 and j - 1 first) are equal."""
    after, before = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name = levels[k][i + after]
        after += ((name >= 0) & (name == levels[k][j + after])).astype(np.int64) << k
        to = i - before - (1 << k)
        name = levels[k][np.maximum(to, 0)]
        before += ((to >= 0) & (name >= 0) & (name == levels[k][np.maximum(to, 0) + (j - i)])).astype(np.int64) << k
    return after, before


class _Known:
    """Stretches found so far, as (start, end, period); of equal stretches the smallest period counts."""

    def __init__(self) -> None:
        self.start = self.end = self.period = np.zeros(0, dtype=np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        long_enough = end - start >= 2 * period
        s, e, p = (
            np.concatenate((old, new[long_enough]))
            for old, new in ((self.start, start), (self.end, end), (self.period, period))
        )
        order = np.lexsort((p, e, s))
        s, e, p = s[order], e[order], p[order]
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
        self.start, self.end, self.period = s[new], e[new], p[new]


def _small_periods(words: np.ndarray, known: _Known) -> None:
    for q in range(1, min(SMALL, len(words))):
        same = np.flatnonzero((words[:-q] == words[q:]) & (words[q:] >= 0))
        if len(same):
            first = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1] + 1)))
            last = np.append(first[1:], len(same)) - 1
            start, end = same[first], same[last] + 1 + q
            known.add(start, end, np.full(len(start), q))


def _synchronising(levels: list[np.ndarray], k: int, known: _Known) -> np.ndarray:
    """Chosen positions at scale 2**k whose context of 2 * 2**k words occurs elsewhere."""
    t, name = 1 << k, levels[k][:-1]
    n = len(name)
    own = np.where(name >= 0, name + (np.int64(k) << np.int64(48)), np.arange(n) + (np.int64(1) << np.int64(56)))
    value = common.mix64(own.astype(np.uint64))
    regular = (3 * known.period <= t) & (known.end - known.start >= t)
    if regular.any():
        change = np.zeros(n + 1, dtype=np.int64)
        np.add.at(change, known.start[regular], 1)
        np.add.at(change, known.end[regular] - t + 1, -1)
        value[np.cumsum(change[:-1]) > 0] = _NEVER
    least = value.copy()
    for j in range(k):
        step = 1 << j
        least[: n - step] = np.minimum(least[: n - step], least[step:])
    first, last = value[: n - t], value[t:]
    least = np.minimum(least[: n - t], last)
    chosen = (least != _NEVER) & ((first == least) | (last == least)) & (levels[k + 1][: n - t] >= 0)
    return np.flatnonzero(chosen)


def _context_pairs(context: np.ndarray, chosen: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of the chosen positions with equal contexts that are 4t to 8t apart."""
    order = chosen[np.argsort(context[chosen], kind="stable")]
    name, at = context[order], np.arange(len(order))
    where, distance = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for step in count(1):
        at = at[at + step < len(order)]
        gap = order[at + step] - order[at]
        near = (name[at + step] == name[at]) & (gap < 8 * t)
        at, gap = at[near], gap[near]
        if not len(at):
            return np.concatenate(where), np.concatenate(distance)
        far = gap >= 4 * t
        where.append(order[at[far]])
        distance.append(gap[far])


def _touching_regions(names: np.ndarray, t: int, known: _Known) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) for each alignment of two touching regions with one small period."""
    regular = np.flatnonzero((3 * known.period <= t) & (known.end - known.start >= 4 * t))
    where, distance = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    b, e, p = known.start[regular], known.end[regular], known.period[regular]
    for r in np.flatnonzero((p[1:] == p[:-1]) & (b[1:] <= e[:-1])):
        alike = np.flatnonzero(names[b[r] : b[r] + p[r]] == names[b[r + 1]])
        if len(alike):
            q = np.arange(4 * t, 8 * t)
            q = q[(q - (b[r + 1] - b[r] - alike[0])) % p[r] == 0]
            x = np.maximum(b[r], b[r + 1] - q)
            inside = x < np.minimum(e[r], e[r + 1] - q)
            where.append(x[inside])
            distance.append(q[inside])
    return np.concatenate(where), np.concatenate(distance)


def find_runs(ids: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of all maximal runs, by start, then period. ``ids``: numbers; -1 equals nothing."""
    levels, known = _names(ids), _Known()
    _small_periods(levels[0][:-1], known)
    for k in range(1, len(levels) - 1):
        t = 1 << k
        chosen = _synchronising(levels, k, known)
        for i, q in (_context_pairs(levels[k + 1], chosen, t), _touching_regions(levels[k], t, known)):
            after, before = _extended(levels, i, i + q)
            known.add(i - before, i + q + after, q)
    length = known.end - known.start
    enough = length >= shortest
    start, length, period = known.start[enough], length[enough], known.period[enough]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _chunks(texts: list[bytes]) -> list[tuple[int, list[list[bytes]]]]:
    """Documents' words in chunks of about ``CHUNK`` words, with the number of the first document."""
    chunks, held = [], CHUNK
    for i, text in enumerate(texts):
        words = text.split()
        if held >= CHUNK:
            chunks.append((i, []))
            held = 0
        chunks[-1][1].append(words)
        held += len(words)
    return chunks


def _of_chunk(documents: list[list[bytes]], shortest: int) -> tuple[list[int], np.ndarray, list[bytes]]:
    """Runs per document, all runs (start in the document, length, period), collapsed texts."""
    number: dict[bytes, int] = {}
    ids, base = [], 0
    for words in documents:  # the same word in another document gets another number
        number = dict(zip(dict.fromkeys(words), count(base)))  # noqa: B905
        base += len(number)
        ids.append(np.array([*map(number.__getitem__, words), -1], dtype=np.int64))
    first = np.cumsum([0, *map(len, ids)])
    start, length, period = find_runs(np.concatenate(ids), shortest)
    owner = np.searchsorted(first, start, "right") - 1
    change = np.zeros(first[-1] + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    dropped = np.cumsum(change) > 0
    n_runs = np.bincount(owner, minlength=len(documents))
    collapsed = [
        b" ".join(words if not n else [w for w, gone in zip(words, dropped[at:].tolist()) if not gone])  # noqa: B905
        for words, n, at in zip(documents, n_runs, first)  # noqa: B905
    ]
    return n_runs.tolist(), np.stack((start - first[owner], length, period), axis=1), collapsed


def periodic_runs(documents: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Per row: doc_id, runs (start, length, period in words; by start, then period), collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. A run is a maximal stretch with smallest period q that has at least
    ``shortest`` and at least 2 q words. ``collapsed`` has the words that are no repetition inside a run (each run keeps its
    first q words), joined by spaces. A text without words (null, empty) has no run and collapses to ''. Each row is judged by
    itself, so repeated rows and shared or null ids have no effect. Memory grows with the longest text, by the logarithm of
    its longest repetition.
    """

    def work(columns: list[pa.Array]) -> dict[str, object] | None:
        n_runs, runs, collapsed = [], [np.zeros((0, 3), dtype=np.int64)], []
        for _, part in _chunks(common.as_bytes(columns[1])):
            n, found, texts = _of_chunk(part, shortest)
            n_runs += n
            runs.append(found)
            collapsed += texts
        table = np.concatenate(runs)
        fields = [pa.array(np.ascontiguousarray(table[:, i])) for i in range(3)]
        offsets = pa.array(np.cumsum([0, *n_runs]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
        return {"doc_id": columns[0], "runs": lists, "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())}

    return common.map_columns(documents, ["doc_id", "text"], _RUNS, lambda c: work(c) if len(c[0]) else None)


def with_planted_period(documents: DataFrame) -> DataFrame:
    """(doc_id, text): where h = crc32(doc_id) is a multiple of 10, the words from number a on repeat the first p of them.

    With g = h div 10 and n words: a = g % n, p = 1 + (n - a) div (3 + g % 8). Null ids and texts without words stay.
    """
    hashed = documents.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    split = hashed.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    g = F.expr("h div 10")
    placed = split.withColumn("a", F.when(F.col("n") > 0, (g % F.col("n")).cast("int")))
    placed = placed.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    edited = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), again), F.lit(1), F.col("n")), " ")
    return placed.select("doc_id", F.when(F.col("p").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def run_digest(runs: DataFrame) -> DataFrame:
    """Numbers and digests of ``periodic_runs``: the longest run (ties: smallest start, then period), all runs, the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    written = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = runs.select("doc_id", "runs", "collapsed", longest.alias("longest"), written.alias("written"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.s")).alias("start"), F.col("longest.l").alias("length"),
        (-F.col("longest.p")).alias("period"), F.expr("(1000 * longest.l) div -longest.p").alias("exponent_milli"),
        F.sha2(F.array_join("written", ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
