"""Near duplicates by a chosen-path similarity join over minwise tokens, then connected components.

Documents with equal shingle sets are one class, named by a hash of the set, and only its first row (smallest doc_id, then
hash of the text) takes part. A class has ``TOKENS`` minwise
tokens. The trees of the join start with ``ROOTS`` nodes a class, one for each of so many tokens. The members of a node
share a path of chosen tokens; a node that takes at most ``COMPARISONS`` times ``SMALL`` squared comparisons is compared
exhaustively, a larger one is branched by further tokens that its path selects, one or two each, which is more than 1 / similarity on average.

Two classes with similarity 0.75 share no node at the start with probability 0.25**16, and a path that they share
goes on with probability above one half at each larger node; 12 of the 16 are shared on average.

Rounds keep the work linear inside large groups of copies. The first two deal the members of a large node into random
parts of at most about ``SMALL``; each member asks the most similar one of another component that it meets, one in all its
nodes, links are confirmed and components contracted. The last one does the branching for nodes that still hold several
components, and compares all members of different components, each pair once. Pairs are compared by a bound that no linked
pair fails: sizes, and parities of hashed shingles (``parity``), which differ in no more bits than the sets do in
shingles. So pairs well below the threshold never become rows. Every link is confirmed on the full sets.
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
from lintlake.llm.parity import Parities, parities

SHINGLE = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
TOKENS = 64
ROOTS = 16
SMALL = 512
#: Bits of the parities for a shingle, at least.
BITS = 2
#: Rounds in which each member asks one other.
ROUNDS = 2
#: A node is compared exhaustively up to so many times SMALL squared comparisons (bits in memory, about a second).
COMPARISONS = 64
#: Levels of branching; nodes that are still large after so many are compared in blocks.
LEVELS = 16
#: Sets held at once while links are confirmed, about.
BLOCK = 64
#: Sets that one task compares while links are confirmed, about, see ``common.merged``.
SETS_A_TASK = 2000
#: The same for members of nodes that are compared.
COMPARED_A_TASK = 5000

_RNG = np.random.default_rng(20)
_MULTIPLY = (_RNG.integers(0, 2**63, TOKENS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, TOKENS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SIGNED = "doc_id long, h long, n_shingles long, key binary, tokens binary, parity binary"


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, no word none."""
    words = common.shingle_words(text)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(SHINGLE, len(h))
    if not n:
        return h
    total = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total = total * _STEP + h[k : k + len(total)]
    return np.unique(common.mix64(total))


def minwise_tokens(shingles: np.ndarray) -> np.ndarray:
    """``TOKENS`` 32-bit minima; two sets agree in each with the probability of their Jaccard similarity."""
    low = np.full(TOKENS, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096]
        np.minimum(low, (part[None, :] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _row() -> list[Column]:
    """doc_id (``NULL_ID`` for null) and a hash of the text: they name a row by what it holds."""
    return [F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("h")]


def _signed(documents: DataFrame) -> DataFrame:
    def work(columns: list[pa.Array]) -> dict[str, object]:
        n, keys, tokens, bits = [], [], [], []
        for text in common.as_bytes(columns[2]):
            found = shingle_set(text)
            n.append(len(found))
            keys.append(blake2b(found.tobytes(), digest_size=16).digest())
            tokens.append(minwise_tokens(found).tobytes())
            bits.append(parities(found, BITS))
        return {
            "doc_id": columns[0], "h": columns[1], "n_shingles": pa.array(n, pa.int64()), "key": pa.array(keys, pa.binary()),
            "tokens": pa.array(tokens, pa.binary()), "parity": pa.array(bits, pa.binary()),
        }

    return common.map_columns(documents.select(*_row(), "text"), ["doc_id", "h", "text"], _SIGNED, work)


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _node(parent: np.ndarray | np.uint64, coordinate: np.ndarray, token: np.ndarray) -> np.ndarray:
    return common.mix64((parent * _STEP) ^ (coordinate.astype(np.uint64) << np.uint64(32)) ^ token.astype(np.uint64))


def _roots(classes: DataFrame) -> DataFrame:
    """The first nodes of every class: one for each of the first ``ROOTS`` tokens."""

    def work(columns: list[pa.Array]) -> dict[str, object]:
        tokens = _matrix(columns[1], "<u4", TOKENS)[:, :ROOTS]
        at = np.arange(ROOTS)
        return {
            "node": pa.array(_node(np.uint64(0), at[None, :], tokens).astype(np.int64).reshape(-1)),
            "used": pa.array(np.tile(np.int64(1) << at, len(tokens))),
            "id": pa.array(np.repeat(columns[0].to_numpy(), ROOTS)),
        }

    return common.map_columns(classes, ["id", "tokens"], "node long, used long, id long", work)


def _children(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Branch nodes: each node's path selects one or two tokens that the path has not used."""

    def work(columns: list[pa.Array]) -> dict[str, object]:
        node, used = columns[0].to_numpy().astype(np.uint64), columns[1].to_numpy()
        tokens = _matrix(columns[4], "<u4", TOKENS)
        out = []
        taken = used.copy()
        for turn in range(2):
            row = np.arange(len(node)) if turn == 0 else np.flatnonzero(node & np.uint64(1))
            at, free = np.zeros(len(row), dtype=np.int64), np.zeros(len(row), dtype=bool)
            for probe in range(4 * TOKENS):  # the first unused coordinate in an order that the node gives
                draw = (common.mix64(node[row] + np.uint64(7919 * (turn + 1)) + np.uint64(probe) * _STEP) % np.uint64(TOKENS)).astype(np.int64)
                new = ~free & ((taken[row] >> draw) & 1 == 0)
                at[new], free = draw[new], free | new
                if free.all():
                    break
            row, at = row[free], at[free]
            taken[row] |= np.int64(1) << at
            out.append((_node(node[row] + np.uint64(1), at, tokens[row, at]), used[row] | (np.int64(1) << at), row))
        row = np.concatenate([x[2] for x in out])
        return {
            "node": pa.array(np.concatenate([x[0] for x in out]).astype(np.int64)),
            "used": pa.array(np.concatenate([x[1] for x in out])),
            "id": columns[2].take(pa.array(row)), "component": columns[3].take(pa.array(row)),
        }

    joined = members.join(classes.select("id", "tokens"), "id")
    schema = "node long, used long, id long, component long"
    return common.map_columns(joined, ["node", "used", "id", "component", "tokens"], schema, work)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by (part, node), cut so that no group is split."""
    kept: list[pa.RecordBatch] = []

    def cut_at(batch: pa.RecordBatch) -> int:
        part, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        changed = np.flatnonzero((part[1:] != part[:-1]) | (node[1:] != node[:-1]))
        return int(changed[-1]) + 1 if len(changed) else 0

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        whole = pa.concat_batches(kept) if len(kept) > 1 else batch
        cut = cut_at(whole)
        if cut:
            yield whole.slice(0, cut)
        kept = [whole.slice(cut)]
    if kept:
        yield kept[0]


def _most_different(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The largest symmetric difference of linked sets of these sizes."""
    return (100 - PERCENT) * (m + n) // (100 + PERCENT)


def _in_order(first: np.ndarray, last: np.ndarray, main: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), i < j and i not main, of the rows of each group (first, last), about a quarter of a million at a time."""
    own = np.flatnonzero(~main)
    rest = np.repeat(last, last - first)[own] - 1 - own
    at = 0
    while at < len(own):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(rest[at:]), 1 << 18)) + at)
        n = rest[at:stop]
        i = np.repeat(own[at:stop], n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = stop


def _best(x: np.ndarray, y: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pair with the smallest gap for each x."""
    order = np.lexsort((y, gap, x))
    order = order[np.concatenate(([True], x[order][1:] != x[order][:-1]))[: len(order)]]
    return x[order], y[order], gap[order]


def _similar_pairs(members: DataFrame, classes: DataFrame, size: int, all_pairs: bool) -> DataFrame:
    """(x, y, gap): members (about ``size`` rows) of one (part, node) and of different components that the bound does not rule out.

    With ``all_pairs`` all of them, x > y. Otherwise the most similar one for each x.
    """
    short = classes.select("id", F.col("n_shingles").alias("n"), "parity")
    rows = members.join(short, "id").select("part", "node", "id", "component", "n", "parity", "main")
    rows = rows.repartition("part", "node").sortWithinPartitions("part", "node", "main", "id")
    rows = common.merged(rows, size, COMPARED_A_TASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            part, node, ids, component, n = (batch.column(i).to_numpy() for i in range(5))
            bits, main = Parities(batch.column(5).to_pylist()), batch.column(6).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (part[1:] != part[:-1]))))
            last = np.append(first[1:], len(ids))
            found = []
            for i, j in _in_order(first, last, main):
                other = (component[i] != component[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
                i, j = i[other], j[other]
                gap = bits.gaps(i, j)
                near = gap <= _most_different(n[i], n[j])
                i, j, gap = i[near], j[near], 1000 * gap[near] // (n[i[near]] + n[j[near]])
                if all_pairs:
                    yield pa.RecordBatch.from_pydict({"x": pa.array(ids[j]), "y": pa.array(ids[i]), "gap": pa.array(gap)})
                else:  # a row for each member is all that is kept of so many pairs
                    found.append(_best(np.concatenate((j, i)), np.concatenate((i, j)), np.concatenate((gap, gap))))
            if found:
                x, y, gap = _best(*map(np.concatenate, zip(*found, strict=True)))
                yield pa.RecordBatch.from_pydict({"x": pa.array(ids[x]), "y": pa.array(ids[y]), "gap": pa.array(gap)})

    return rows.mapInArrow(run, "x long, y long, gap long")


def _sets(documents: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """Full shingle sets of the classes named by ``ids``: the texts of their first rows are read again."""
    wanted = classes.select("id", "doc_id", "h").join(ids, "id", "left_semi")
    rows = documents.select(*_row(), "text").join(wanted, ["doc_id", "h"]).select("id", "text")

    def work(columns: list[pa.Array]) -> dict[str, object]:
        found = [shingle_set(text).tobytes() for text in common.as_bytes(columns[1])]
        return {"id": columns[0], "shingles": pa.array(found, pa.binary())}

    sets = common.map_columns(rows, ["id", "text"], "id long, shingles binary", work)
    return common.stored(sets.groupBy("id").agg(F.max("shingles").alias("shingles")))


def _in_component_blocks(sets: DataFrame, named: DataFrame) -> DataFrame:
    """Deal the sets into blocks that stay inside a component: what is like one member is like others of it."""
    placed = sets.join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = placed.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(5), "id"), F.col("parts"))
    return placed.join(parts, "component").select("id", "shingles", F.xxhash64("component", part).alias("block"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold.

    The sets of the y side are held block by block, and each x comes once for all its partners in a block.
    """
    block = F.col("block")
    placed = pairs.select("x", "y").join(sets.select(F.col("id").alias("y"), "block"), "y")
    asked = placed.groupBy("x", "block").agg(F.collect_set("y").alias("ys"))
    own = sets.select(F.col("id").alias("x"), "shingles")
    asked = asked.join(own, "x").select("block", F.lit(1).alias("turn"), "x", "shingles", "ys")
    wanted = pairs.select(F.col("y").alias("id")).distinct()
    held = sets.join(wanted, "id", "left_semi").withColumnRenamed("id", "y")
    held = held.select(block, F.lit(0).alias("turn"), F.col("y").alias("x"), "shingles", F.lit(None).cast("array<long>").alias("ys"))
    rows = held.unionByName(asked).repartition("block").sortWithinPartitions("block", "turn")
    rows = common.merged(rows, 2 * pairs.count(), SETS_A_TASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, have = None, {}
        for batch in common.slices(batches, 100):
            xs, ys = [], []
            for b, turn, x, raw, asks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != at:
                    at, have = b, {}
                a = np.frombuffer(raw, dtype=np.uint64)
                if turn == 0:
                    have[x] = a
                    continue
                for y in asks:
                    both = np.concatenate((a, have[y]))
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= PERCENT * (len(both) - shared):
                        xs.append(x)
                        ys.append(y)
            if xs:
                yield pa.RecordBatch.from_pydict({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})

    return rows.mapInArrow(run, "x long, y long")


def _shared_nodes(members: DataFrame) -> DataFrame:
    """Members of the nodes that hold several components, with the number of members and of comparisons.

    Comparisons are those of the members outside the largest component (``main``) with all members.
    """
    parts = members.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = parts.groupBy("node").agg(
        F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("parts")
    )
    work = F.col("size") * (F.col("size") - F.col("largest.n"))
    sizes = sizes.filter("parts > 1").select("node", "size", work.alias("work"), F.col("largest.component").alias("main"))
    return members.join(sizes, "node").withColumn("main", F.col("component") == F.col("main"))


def _links(documents: DataFrame, classes: DataFrame) -> DataFrame:
    roots = common.stored(_roots(classes))
    n_roots = roots.count()
    links, sets, named = None, None, None
    for turn in range(ROUNDS + 1):
        mine = roots.withColumn("component", F.col("id"))
        if turn:
            named = components(links)
            mine = roots.join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))
        nodes = common.stored(_shared_nodes(mine), n_roots)
        size = nodes.count()
        if turn < ROUNDS:
            parts = F.ceil(F.col("size") / SMALL)
            dealt = nodes.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "node", "id"), parts))
            asked = common.stored(_similar_pairs(dealt, classes, size, all_pairs=False))
            if sets is None:  # of all members that a later pair can name: those that met a similar one, or not all others
                touched = asked.select(F.explode(F.array("x", "y")).alias("id")).union(nodes.filter(F.col("size") > SMALL).select("id"))
                sets = _sets(documents, classes, touched.distinct())
            pairs = asked.groupBy("x").agg(F.min_by("y", F.struct("gap", "y")).alias("y"))
        else:
            leaves = _leaves(nodes, classes)
            pairs = _similar_pairs(leaves, classes, leaves.count(), all_pairs=True)
        pairs = common.stored(pairs.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), size)
        blocks = _in_component_blocks(sets, named) if named is not None else sets.withColumn("block", F.xxhash64("id"))
        found = _confirmed(pairs, blocks)
        links = common.stored(links.unionByName(found) if links is not None else found, size)
    return links


def _leaves(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Nodes that are compared exhaustively: small ones, and large ones branched until they are small."""
    few = F.col("work") <= COMPARISONS * SMALL * SMALL
    leaves = nodes.filter(few).withColumn("part", F.lit(0).cast("long"))
    large = nodes.filter(~few)
    for _ in range(LEVELS):
        if large.isEmpty():
            break
        below = common.stored(_shared_nodes(_children(large, classes)))
        leaves = leaves.unionByName(below.filter(few).withColumn("part", F.lit(0).cast("long")))
        large = below.filter(~few)
    else:
        leaves = leaves.unionByName(_in_blocks(large))
    return leaves.drop("used", "size", "work")


def _in_blocks(large: DataFrame) -> DataFrame:
    """Nodes that no token splits: members are dealt into blocks, and every two blocks meet in one part."""
    n = F.ceil(2 * F.col("size") / SMALL)
    mine = F.pmod(F.xxhash64(F.lit(9), "id"), n)
    other = F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other")
    met = large.select("node", "used", "id", "component", "size", "work", "main", mine.alias("mine"), other)
    pair = F.struct(F.least("mine", "other"), F.greatest("mine", "other"))
    return met.withColumn("part", F.xxhash64(pair)).drop("mine", "other")


def _grouped(documents: DataFrame) -> DataFrame:
    """Per row: doc_id (``NULL_ID`` for null), h, n_shingles, and ``first``: the doc_id and h of the first row of its component."""
    signed = common.stored(_signed(documents))
    classes = signed.filter("n_shingles > 0").groupBy("key").agg(
        F.min(F.struct("doc_id", "h")).alias("first"), F.min("tokens").alias("tokens"), F.min("parity").alias("parity"),
        F.min("n_shingles").alias("n_shingles"),
    )
    columns = ["key", "first", "first.doc_id", "first.h", "tokens", "parity", "n_shingles"]
    classes = common.stored(classes.select(F.xxhash64("key").alias("id"), *columns))
    named = components(_links(documents, classes))
    least = classes.select("id", "first").join(named, "id").groupBy("component").agg(F.min("first").alias("least"))
    of_class = named.join(least, "component").select("id", "least")
    of_key = classes.select("id", "key", "first").join(of_class, "id", "left").select("key", F.coalesce("least", "first").alias("first"))
    found = signed.select("doc_id", "h", "n_shingles", "key").join(of_key, "key", "left")
    return found.select("doc_id", "h", "n_shingles", F.coalesce("first", F.struct("doc_id", "h")).alias("first"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    A text without words (null, empty) is linked with nothing. Rows are linked by their texts alone: texts that share a
    doc_id, or have none, are each judged by themselves, and rows that repeat both get the same answer. A null
    doc_id is the largest id, so it never names a component that has another id. Rows whose doc_id is their component's
    are kept; two such rows can share an id.
    """
    real = lambda c: F.when(c != common.NULL_ID, c)
    return _grouped(documents).select(
        real(F.col("doc_id")).alias("doc_id"), "n_shingles", real(F.col("first.doc_id")).alias("component_id"),
        (F.col("first.doc_id") == F.col("doc_id")).alias("kept"),
    )


def representatives(documents: DataFrame) -> DataFrame:
    """The rows that stay, one of each group, all columns as they were; rows that repeat id and text stay once."""
    gone = _grouped(documents).filter(F.col("first") != F.struct("doc_id", "h"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    doc_id, h = _row()
    packed = documents.select(
        F.struct(*documents.columns).alias("doc"), doc_id.alias("id"), h, F.xxhash64(*documents.columns).alias("order")
    )
    kept = packed.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("h") == F.col("gone_h")), "left_anti")
    one = kept.groupBy("id", "h").agg(F.min_by("doc", "order").alias("doc"))
    return one.select(*[F.col(f"doc.{c}").alias(c) for c in documents.columns])
