"""Jaccard join of documents on word n-grams by vertical partitioning, then connected components.

The global order of n-grams is the order of their 64-bit hashes. It is cut into fragments, and a document's set into the
segments that fall into them.

Candidates. Sets of sizes m and n that link differ in at most d = (100 - P) (m + n) / (100 + P) n-grams, so in at most d
segments. Sizes are dealt into classes by powers of two, each with a number of fragments well above its d. Of the segments
of a document (by content and place), the first d + 1 in one common order are its signatures: two sets that link share at
least one of them. The order puts segments with many n-grams first, so that one frequent n-gram alone is hardly ever a
signature. Documents near the upper end of their class are in the next one too; sets with no more than d segments
also get a signature that stands for that. So no link is lost.

Links. A set shares a signature with few others, unless these are copies. Each set first asks one candidate, then the most similar
one of another component. Then, in groups that still hold several components, members that can reach the threshold by a bound
(the parities of hashed n-grams differ in no more places than the sets do) are gathered, each in one place, and those of
different components are compared there by their full sets; only links leave. Pairs are confirmed on the full
sets: each fragment counts its partial overlaps by itself, and the counts are summed per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm import common
from lintlake.llm.components import components
from lintlake.llm.parity import folded, parities

#: Words of a shingle.
SHINGLE = 4
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Members of a signature that one task holds, and n-grams of a member, about, where full sets are held.
HELD = 512
SHINGLES_HELD = 1000
#: Sets that ask one other set in one task.
ASKS = 1024
#: Fragments (a power of two) in which partial overlaps are counted.
FRAGMENTS = 4
#: Rows that one task compares by parities, and pieces of sets that it counts overlaps of, about, see ``common.merged``.
COMPARED_A_TASK = 5000
PIECES_A_TASK = 8000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SIGNED = "doc_id long, h long, n_shingles long, id long, signatures binary, parity binary"


def shingle_set(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, no word none."""
    words = common.shingle_words(text)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(n, len(h))
    if not n:
        return h
    total = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total = total * _STEP + h[k : k + len(total)]
    return np.unique(common.mix64(total))


def most_different(m: int, n: int) -> int:
    """The largest symmetric difference of linked sets of these sizes."""
    return (100 - PERCENT) * (m + n) // (100 + PERCENT)


def signatures(shingles: np.ndarray) -> np.ndarray:
    """Hashes of the segments that any linked set shares at least one of (in one of the size classes of both)."""
    n = len(shingles)
    largest = 100 * n // PERCENT
    d = most_different(n, largest)
    if not d:  # only equal sets link
        return np.zeros(0, dtype=np.uint64)
    out = []
    for kind in range(n.bit_length(), largest.bit_length() + 1):
        fragments = np.uint64((1 << kind) // 5 + 4)
        place = ((shingles >> np.uint64(32)) * fragments) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        size = np.diff(first, append=n)
        segment = common.mix64(np.add.reduceat(shingles, first) ^ (place[first] * _STEP + np.uint64(kind)))
        if len(segment) > d + 1:
            order = ((255 - np.minimum(size, 255)).astype(np.uint64) << np.uint64(56)) | (segment >> np.uint64(8))
            segment = segment[np.argpartition(order, d)[: d + 1]]
        elif len(segment) <= d:
            segment = np.append(segment, common.mix64(np.array([kind], dtype=np.uint64)))
        out.append(segment)
    return np.concatenate(out)


def _row() -> list[Column]:
    """doc_id (``NULL_ID`` for null) and a hash of the text: they name a row by what it holds."""
    return [F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("h")]


def _signed(documents: DataFrame) -> DataFrame:
    """Size, name (a hash of the whole set), signatures and parities of every document's set."""

    def work(columns: list[pa.Array]) -> dict[str, object]:
        sets = [shingle_set(t) for t in common.as_bytes(columns[2])]
        names = b"".join(blake2b(s.tobytes(), digest_size=8).digest() for s in sets)
        return {
            "doc_id": columns[0], "h": columns[1], "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "id": pa.array(np.frombuffer(names, dtype=np.int64)),
            "signatures": pa.array([signatures(s).tobytes() for s in sets], pa.binary()),
            "parity": pa.array([parities(s) for s in sets], pa.binary()),
        }

    return common.map_columns(documents.select(*_row(), "text"), ["doc_id", "h", "text"], _SIGNED, work)


def _members(signed: DataFrame) -> DataFrame:
    """(signature, id, least, weight) of the signatures that several sets have.

    least: the smallest id among them; weight: the number of signatures that the very same sets have.
    """

    def work(columns: list[pa.Array]) -> dict[str, object]:
        cells = columns[1].to_pylist()
        signature = np.frombuffer(b"".join(cells), dtype=np.int64)
        times = [len(x) // 8 for x in cells]
        return {"signature": pa.array(signature), "id": pa.array(np.repeat(columns[0].to_numpy(), times))}

    rows = common.map_columns(signed, ["id", "signatures"], "signature long, id long", work)
    shared = rows.groupBy("signature").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least <> most")
    members = common.stored(rows.join(shared.select("signature", "least"), "signature").distinct())
    # Signatures with the same members would give the same pairs once each: one of them stands for all.
    name = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"h{k}") for k in range(2)]
    same = members.groupBy("signature").agg(F.count(F.lit(1)).alias("size"), *name).groupBy("size", "h0", "h1")
    kinds = same.agg(F.min("signature").alias("signature"), F.count(F.lit(1)).alias("weight")).select("signature", "weight")
    return members.join(kinds, "signature")


def _pieces(documents: DataFrame, signed: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n, fragment, shingles): the full sets of ``ids``, cut into ``FRAGMENTS`` fragments; texts are read again."""
    first = signed.groupBy("id").agg(F.min(F.struct("doc_id", "h")).alias("first")).join(ids, "id", "left_semi")
    first = first.select("id", "first.doc_id", "first.h")
    rows = documents.select(*_row(), "text").join(first, ["doc_id", "h"]).dropDuplicates(["id"]).select("id", "text")

    def work(columns: list[pa.Array]) -> dict[str, object] | None:
        out = []
        for i, text in zip(columns[0].to_pylist(), common.as_bytes(columns[1]), strict=True):
            s = shingle_set(text)
            cut = np.searchsorted(s >> np.uint64(32), np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64(2**32 // FRAGMENTS))
            out += [(i, len(s), k, part.tobytes()) for k, part in enumerate(np.split(s, cut)) if len(part)]
        if not out:
            return None
        ids, n, fragment, shingles = zip(*out, strict=True)
        return {
            "id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "fragment": pa.array(fragment, pa.int32()),
            "shingles": pa.array(shingles, pa.binary()),
        }

    return common.map_columns(rows, ["id", "text"], "id long, n long, fragment int, shingles binary", work)


def _confirmed(pairs: DataFrame, pieces: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold: partial overlaps are counted by fragment and summed per pair.

    A set that very many others ask is copied to one group for ``ASKS`` of them each; a task holds one piece at a time.
    """
    groups = pairs.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / ASKS).alias("groups"))
    asked = pairs.join(groups, "y").select("x", "y", F.pmod(F.xxhash64("x"), F.col("groups")).alias("grp"))
    own = pieces.select(F.col("id").alias("x"), "n", "fragment", "shingles")
    asks = asked.join(own, "x").select("y", "grp", "fragment", F.lit(1).alias("turn"), "x", "n", "shingles")
    held = groups.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    held = held.join(pieces.withColumnRenamed("id", "y"), "y")
    held = held.select("y", "grp", "fragment", F.lit(0).alias("turn"), F.col("y").alias("x"), "n", "shingles")
    rows = held.unionByName(asks).repartition("y", "grp", "fragment").sortWithinPartitions("y", "grp", "fragment", "turn")
    rows = common.merged(rows, 2 * FRAGMENTS * pairs.count(), PIECES_A_TASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, have, n_have = None, None, 0
        for batch in common.slices(batches, 100):
            out = []
            for y, grp, fragment, turn, x, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                piece = np.frombuffer(raw, dtype=np.uint64)
                if turn == 0:
                    at, have, n_have = (y, grp, fragment), piece, n
                elif at == (y, grp, fragment):
                    both = np.concatenate((have, piece))
                    both.sort(kind="stable")
                    out.append((x, y, n + n_have, int((both[1:] == both[:-1]).sum())))
            if out:
                x, y, sizes, overlap = zip(*out, strict=True)
                columns = {"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64()), "sizes": pa.array(sizes, pa.int64())}
                yield pa.RecordBatch.from_pydict(columns | {"overlap": pa.array(overlap, pa.int64())})

    partial = rows.mapInArrow(run, "x long, y long, sizes long, overlap long")
    whole = partial.groupBy("x", "y").agg(F.sum("overlap").alias("overlap"), F.max("sizes").alias("sizes"))
    return whole.filter(f"100 * overlap >= {PERCENT} * (sizes - overlap)").select("x", "y")


def _groups(members: DataFrame, named: DataFrame, load: Column | None = None) -> DataFrame:
    """Members of the signatures that hold several components, dealt into parts of a ``load`` of at most about ``HELD``.

    Each is held in one part (turn 0). Those outside the largest component also ask in all parts (turn 1).
    """
    placed = members.select("signature", "id", (F.lit(1) if load is None else load).alias("load")).join(named, "id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "id"))
    sizes = placed.groupBy("signature", "component").agg(F.sum("load").alias("load"), F.count(F.lit(1)).alias("n")).groupBy("signature").agg(
        F.sum("load").alias("load"), F.count(F.lit(1)).alias("kinds"), F.max_by("component", F.struct("n", "component")).alias("largest")
    )
    sizes = sizes.filter("kinds > 1").select("signature", F.ceil(F.col("load") / HELD).alias("parts"), "largest")
    met = placed.drop("load").join(sizes, "signature")
    held = met.select("signature", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), F.lit(0).alias("turn"), "id", "component")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    asks = met.filter("component <> largest").select("signature", part, F.lit(1).alias("turn"), "id", "component")
    return held.unionByName(asks)


def _met(groups: DataFrame, of_id: DataFrame) -> DataFrame:
    """The rows of ``groups`` with the columns of ``of_id``, a group after the other, those that are held first."""
    rows = groups.join(of_id, "id").select("signature", "part", "turn", "id", "component", *[c for c in of_id.columns if c != "id"])
    rows = rows.repartition("signature", "part").sortWithinPartitions("signature", "part", "turn")
    return common.merged(rows, groups.count(), COMPARED_A_TASK)


def _asking(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[list[list], list]]:
    """Every row that asks, after the rows that its group holds (one list for the whole group)."""
    at, held = None, []
    for batch in common.slices(batches, rows):
        for signature, part, turn, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (signature, part) != at:
                at, held = (signature, part), []
            if turn == 0:
                held.append(row)
            elif held:
                yield held, row


class _Shapes:
    """Sizes and parities of the members that a group holds."""

    def __init__(self, held: list[list]):
        self.width = min(len(h[3]) for h in held)
        self.ids, self.components, self.sizes = (np.array([h[k] for h in held]) for k in range(3))
        self.words = folded([h[3] for h in held], self.width)

    def possible(self, component: int, n: int, parity: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places and gaps of the members of other components that a set of this shape may be linked with."""
        words, own = self.words, folded([parity], min(self.width, len(parity)))[0]
        if len(parity) < self.width:
            words = np.bitwise_xor.reduce(words.reshape(len(words), -1, len(parity) // 8), axis=1)
        gap = np.bitwise_count(words ^ own).sum(axis=1, dtype=np.int64)
        most = (100 - PERCENT) * (self.sizes + n) // (100 + PERCENT)
        can = np.flatnonzero((gap <= most) & (np.abs(self.sizes - n) <= most) & (self.components != component))
        return can, (1000 * gap[can]) // (self.sizes[can] + n)


def _batch(rows: list[tuple], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(names, zip(*rows, strict=True), strict=True)})


def _nearest(groups: DataFrame, shapes: DataFrame) -> DataFrame:
    """(x, y): for each member that asks, the most similar one of another component that the parities don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, out = None, None, []
        for held, (i, component, n, parity) in _asking(batches, 2000):
            if held is not now:
                now, at = held, _Shapes(held)
            can, gap = at.possible(component, n, parity)
            if len(can):
                one = np.lexsort((at.ids[can], gap))[0]
                out.append((i, int(at.ids[can[one]]), int(gap[one])))
            if len(out) >= 10_000:
                yield _batch(out, "x", "y", "gap")
                out = []
        if out:
            yield _batch(out, "x", "y", "gap")

    near = _met(groups, shapes).mapInArrow(run, "x long, y long, gap long")
    return near.groupBy("x").agg(F.min_by("y", F.struct("gap", "y")).alias("y"))


def _may_be_linked(groups: DataFrame, shapes: DataFrame) -> DataFrame:
    """(x, y): enough pairs to connect all members of different components that the parities don't rule out.

    Each member is paired with the smallest id that it is connected with in its group, so rows are at most as many as
    members, however many pairs are possible.
    """

    def connected(ids: np.ndarray, label: np.ndarray, asked: dict[int, int]) -> list[tuple]:
        every = np.concatenate((ids, np.fromiter(asked, np.int64, len(asked))))
        of = np.concatenate((label, label[np.fromiter(asked.values(), np.int64, len(asked))]))
        least = np.full(len(ids), common.NULL_ID)
        np.minimum.at(least, of, every)
        return [(x, y) for x, y in zip(every.tolist(), least[of].tolist(), strict=True) if x != y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, label, asked, out = None, None, None, {}, []
        for held, (i, component, n, parity) in _asking(batches, 2000):
            if held is not now:
                if asked:
                    out += connected(at.ids, label, asked)
                now, at, label, asked = held, _Shapes(held), np.arange(len(held)), {}
            can, _ = at.possible(component, n, parity)
            if len(can):
                label[np.isin(label, label[can])] = label[can[0]]
                asked[i] = int(can[0])
            if len(out) >= 10_000:
                yield _batch(out, "x", "y")
                out = []
        if asked:
            out += connected(at.ids, label, asked)
        if out:
            yield _batch(out, "x", "y")

    return _met(groups, shapes).mapInArrow(run, "x long, y long").distinct()


class _Sets:
    """The full sets that a group holds, as one sorted list of n-grams with their owners."""

    def __init__(self, held: list[list]):
        self.ids, self.label = (np.array([h[k] for h in held]) for k in range(2))
        sets = [_whole(h[2]) for h in held]
        self.sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.shingles, self.owner = every[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def overlaps(self, own: np.ndarray) -> np.ndarray:
        """How many n-grams of a set each of the sets has."""
        first = np.searchsorted(self.shingles, own, "left")
        times = np.searchsorted(self.shingles, own, "right") - first
        at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
        return np.bincount(self.owner[at], minlength=len(self.ids))


def _whole(fragments: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(fragments), dtype=np.uint64)


def _linked(groups: DataFrame, pieces: DataFrame) -> DataFrame:
    """(x, y): links that connect all members of different components whose full sets reach the threshold.

    Sets are compared where they are held: what is not linked makes no row, and of links one for each two components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, joined, out = None, None, {}, []
        for held, (i, component, fragments) in _asking(batches, 200):
            if held is not now:
                now, at, joined = held, _Sets(held), {}
            while component in joined:
                component = joined[component]
            own = _whole(fragments)
            overlap = at.overlaps(own)
            can = np.flatnonzero((100 * overlap >= PERCENT * (at.sizes + len(own) - overlap)) & (at.label != component))
            labels, first = np.unique(at.label[can], return_index=True)
            for label, k in zip(labels.tolist(), first.tolist(), strict=True):
                out.append((i, int(at.ids[can[k]])))
                joined[label] = component
                at.label[at.label == label] = component
            if len(out) >= 10_000:
                yield _batch(out, "x", "y")
                out = []
        if out:
            yield _batch(out, "x", "y")

    whole = pieces.join(groups.select("id").distinct(), "id", "left_semi").groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("fragment", "shingles"))), lambda p: p["shingles"]).alias("fragments")
    )
    return _met(groups, whole).mapInArrow(run, "x long, y long")


def links(documents: DataFrame, signed: DataFrame) -> DataFrame:
    """(x, y): links between the names of different sets; enough of them to connect all sets that are linked."""
    members = common.stored(_members(signed))
    n_members = members.count()
    ids = members.select("id").distinct()
    pieces = common.stored(_pieces(documents, signed, ids))
    shapes = signed.select("id", F.col("n_shingles").alias("n"), "parity").join(ids, "id", "left_semi").dropDuplicates(["id"])
    shapes = common.stored(shapes)

    def with_confirmed(found: DataFrame, pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        return common.stored(found.unionByName(_confirmed(common.stored(pairs, n_members), pieces)), n_members)

    asks = members.filter("id <> least").groupBy("id", "least").agg(F.sum("weight").alias("n"))
    one = asks.groupBy(F.col("id").alias("x")).agg(F.max_by("least", F.struct("n", "least")).alias("y"))
    found = common.stored(_confirmed(common.stored(one, n_members), pieces), n_members)
    groups = common.stored(_groups(members, components(found)), n_members)
    if groups.isEmpty():
        return found
    found = with_confirmed(found, _nearest(groups, shapes))
    named = components(found)
    groups = common.stored(_groups(members, named), n_members)
    if groups.isEmpty():
        return found
    # What may still be linked is gathered once, whatever number of signatures it shares, and compared by full sets.
    near = components(common.stored(_may_be_linked(groups, shapes), n_members))
    load = F.greatest(F.lit(1), F.col("n") / SHINGLES_HELD)
    gathered = near.select(F.col("component").alias("signature"), "id").join(shapes.select("id", "n"), "id")
    blocks = common.stored(_groups(gathered, named, load), n_members)
    return found if blocks.isEmpty() else with_confirmed(found, _linked(blocks, pieces))


def ngram_components(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included).

    A text without words (null, empty) is linked with nothing. Rows are linked by their texts alone: texts that share a
    doc_id, or have none, are each judged by themselves, and rows that repeat both get the same answer. A null doc_id
    is the largest id, so it never names a component that has another id. Sets are named by 64-bit hashes.
    """
    signed = common.stored(_signed(documents))
    named = components(links(documents, signed))
    first = signed.filter("n_shingles > 0").groupBy("id").agg(F.min("doc_id").alias("first"))
    placed = first.join(named, "id", "left").select("id", "first", F.coalesce("component", "id").alias("component"))
    least = placed.groupBy("component").agg(F.min("first").alias("least"))
    of_set = placed.join(least, "component").select("id", "least")
    found = signed.select("doc_id", "n_shingles", "id").join(of_set, "id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    real = lambda c: F.when(c != common.NULL_ID, c)
    return found.select(real(F.col("doc_id")).alias("doc_id"), "n_shingles", real(component).alias("component_id"))
