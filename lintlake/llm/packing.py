"""Best-fit decreasing packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import re
from array import array
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm import common

CAPACITY = 1024
END_ID = 2
#: Pieces in one ranking group, on average.
GROUP_ROWS = 20_000
#: Words whose ids a worker remembers.
REMEMBERED = 300_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> tuple[str, str]:
    """Places of the tokenizer file and of the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of whole texts as little-endian 32-bit values.

    The vocabulary's pattern starts a new token at each space between two other characters, so words at such spaces
    are encoded one by one and remembered. Texts with other white space beside a space are encoded as a whole,
    texts that hold the special token's string by the tokenizer itself.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._path = tokenizer_path
        self._encode = fast.encode_ordinary
        self._beside = re.compile(r"\s | \s").search

        class Known(dict):
            def __missing__(known, word: str) -> bytes:
                got = self._ids(" " + word)
                if len(known) < REMEMBERED:
                    known[word] = got
                return got

        self._known = Known().__getitem__

    def _ids(self, text: str) -> bytes:
        return array("I", self._encode(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if "<|endoftext|>" in text:
            return array("I", _tokenizer(self._path).encode(text, add_special_tokens=False).ids).tobytes()
        if self._beside(text):
            return self._ids(text)
        first, *words = text.split(" ")
        return self._ids(first) + b"".join(map(self._known, words))


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _encoder(tokenizer_path: str, ranks_path: str) -> Encoder:
    return Encoder(tokenizer_path, ranks_path)


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: full ones, before them the rest."""
    rest = n % capacity
    return [(0, rest)] * bool(rest) + [(s, capacity) for s in range(rest, n, capacity)]


def token_pieces(documents: DataFrame, capacity: int = CAPACITY, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """A row per piece of each document's ids (null text: the end id alone)."""
    paths = tokenizer or default_tokenizer()
    end = array("I", [END_ID]).tobytes()

    def work(columns: list[pa.Array]) -> dict[str, object]:
        encode = _encoder(*paths)
        out = []
        for doc_id, text in zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True):
            ids = (encode(text) if text else b"") + end
            for piece, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                out.append((doc_id, piece, start, length, crc32(ids[4 * start : 4 * (start + length)])))
        doc, piece, start, length, crc = zip(*out, strict=True)
        return {
            "doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
        }

    return common.map_columns(documents, ["doc_id", "text"], _PIECES, lambda c: work(c) if len(c[0]) else None)


class OpenBins:
    """Segment tree over remaining capacities: the tightest open bins for a length in logarithmic time.

    Bins with the same remaining capacity are alike, so a leaf holds them as ranges of bin numbers.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _count(self, room: int, change: int) -> None:
        node = self.leaves + room
        while node:
            self.open[node] += change
            node //= 2

    def add(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.ranges[room].append((first, n))
            self._count(room, n)

    def take(self, room: int, most: int) -> tuple[int, int]:
        first, n = self.ranges[room].pop()
        if n > most:
            self.ranges[room].append((first + most, n - most))
        self._count(room, -min(n, most))
        return first, min(n, most)

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that some bin has."""
        node = self.leaves + length
        if self.open[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing for ``counts[length]`` pieces; rows (length, first rank, first bin, per bin, offset).

    Pieces of one length are alike too: the tightest bin takes pieces until no further one fits, then the next one
    does, just as if they came singly. So the work depends on the number of lengths and of ranges, which the capacity
    bounds, and not on the number of pieces.
    """
    bins, n_bins, plan = OpenBins(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            fit = (room or capacity) // length
            want = max(1, left // fit)
            if room is None:
                first, n = n_bins, want
                n_bins += n
            else:
                first, n = bins.take(room, want)
            each = min(fit, left)
            plan.append((length, rank, first, each, capacity - (room or capacity)))
            bins.add((room or capacity) - each * length, first, n)
            rank += n * each
            left -= n * each
    return plan


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """Every piece with its sequence and the offset there.

    The pieces (five numbers each) are stored once. Their lengths are counted, the plan is made from at most
    ``capacity`` counts, and each piece finds its place by its rank among pieces of its length. Ranks come from
    groups of about ``GROUP_ROWS`` pieces plus the counts of the groups before, so a length that a third of all
    pieces have is many groups. Repeated documents are packed each; ties in the ranking are rows that are alike.
    """
    spark = documents.sparkSession
    pieces = common.stored(token_pieces(documents, capacity, tokenizer))
    groups = max(1, pieces.count() // GROUP_ROWS)
    grouped = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    sizes = grouped.groupBy("length", "grp").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = np.array(best_fit_plan(counts, capacity), dtype=np.int64).reshape(-1, 5)
    plan = spark.sparkContext.broadcast(plan[np.lexsort((plan[:, 1], plan[:, 0]))])

    earlier = Window.partitionBy("length").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "grp", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "grp").orderBy("doc_id", "piece", "ids_crc32")
    ranked = grouped.withColumn("pos", F.row_number().over(order) - 1).join(before, ["length", "grp"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def work(cols: list[pa.Array]) -> dict[str, object]:
        length, rank = cols[3].to_numpy(), cols[5].to_numpy()
        steps = plan.value
        step = steps[np.searchsorted(steps[:, 0] * (1 << 40) + steps[:, 1], length * (1 << 40) + rank, "right") - 1]
        place = rank - step[:, 1]
        return dict(zip(columns, cols, strict=False)) | {
            "sequence_id": pa.array(step[:, 2] + place // step[:, 3]),
            "offset": pa.array(step[:, 4] + place % step[:, 3] * length),
        }

    placed = ranked.select(*columns, (F.col("before") + F.col("pos")).alias("rank"))
    return common.map_columns(
        placed, [*columns, "rank"], _PIECES + ", sequence_id long, offset long", lambda c: work(c) if len(c[0]) else None
    )
