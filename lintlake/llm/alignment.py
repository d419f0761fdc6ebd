"""Alignment of two tokenizers over a corpus, worked out once for each distinct text.

Documents are shuffled by their full text; each distinct text is encoded by both tokenizers and aligned once, with the
number of rows that hold it as its weight. Groups are the stretches between byte offsets at which tokens of both end; links
are the pairs of tokens whose bytes overlap. The count of an id pair is the number of documents that hold it linked. Counts
are summed in each task, then by pair, and go back to the texts in blocks of bounded size, each a range of A ids.
The measures of a text are joined to its rows by a 128-bit key of the text.

A text (with a space before it) is cut before each single space or line break that stands between two other characters.
Both tokenizers have a token border there (A by its pattern, B as no piece has a space or break behind another character),
so the parts are encoded one by one and remembered. Where B's pieces don't allow that, a text is one part.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import cache, reduce
from hashlib import sha256
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm import common

#: Parts of texts that a worker remembers.
REMEMBERED = 300_000
#: Characters of the texts that are looked at together, about (a text is never cut).
TOGETHER = 1_000_000
#: Id pairs of one broadcast block (16 bytes and a flag each).
BLOCK_PAIRS = 2_000_000
_MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_ALIGNED = "ka long, kb long, weight long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_PARTS = re.compile(r"(?<=\S)(?=[ \n]\S)")
_ODD = re.compile(r"\s\s|[^\S \n]|\A\s|\s\Z")


def default_tokenizers() -> tuple[str, str]:
    """Places of the files of A (byte-level BPE) and B (pieces with byte fallback)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spaced(part: str) -> str:
    """The bytes that a part stands for."""
    return part if part[0] in " \n" else " " + part


def byte_letters() -> dict[str, int]:
    """The characters that byte-level vocabularies use: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers: ids and token bytes of parts, and their alignment."""

    def __init__(self, path_a: str, path_b: str):
        import json

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, size_a = byte_letters(), max(model["vocab"].values()) + 1
        self.bytes_a = [b""] * size_a
        for token, i in model["vocab"].items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [model["vocab"][t] for t in merged] != list(range(256, 256 + len(merged))):
            raise ValueError("the ids of A are not in the order of its merges")
        ranks = {self.bytes_a[i]: i for i in range(256 + len(merged))}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._encode_a = self.a.encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_b = self.b.vocab_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.separable = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
        self.kind = "<u4" if size_a * self.size_b < 2**32 else "<u8"
        self.lengths = [np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b)]
        self.known: dict[str, tuple] = {}

    def parts(self, text: str) -> list[str]:
        """The parts of a text. A space before a part is left out, so that one is written with it where it has more."""
        if not self.separable:
            return [" " + text]
        if _ODD.search(text):
            return _PARTS.split(" " + text)
        return text.replace("\n", " \n").split(" ")

    def ids(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B for parts with a space before them (B adds its own) or a line break at their start.

        Before a break, "x" stands for what comes before it; no piece reaches over the break.
        """
        asked = [p[1:] if p[0] == " " else "x" + p if p[0] == "\n" else p for p in parts]
        ids_b = self.b.encode(asked, num_threads=1)
        ids_b = [i[1:] if p[0] == "\n" else i for i, p in zip(ids_b, parts, strict=True)]
        return list(map(self._encode_a, map(spaced, parts))), ids_b

    def align(self, parts: list[str]) -> list[tuple[int, int, int, str, bytes] | None]:
        """Per part: tokens of A, tokens of B, groups, the groups written out, codes of linked pairs. None: the bytes differ."""
        ids = self.ids(parts)
        joined = [[b"".join(map(table.__getitem__, i)) for i in of] for table, of in ((self.bytes_a, ids[0]), (self.bytes_b, ids[1]))]
        good = [k for k, p in enumerate(parts) if joined[0][k] == joined[1][k] == spaced(p).encode()]
        out: list = [None] * len(parts)
        if not good:
            return out
        # The good parts lie one after another; an end at which both have a border ends a group, and every part.
        sizes = [np.array([len(of[k]) for k in good]) for of in ids]
        flat = [np.fromiter(chain.from_iterable(of[k] for k in good), dtype=np.int64, count=int(n.sum())) for of, n in zip(ids, sizes, strict=True)]
        end = [np.cumsum(self.lengths[side][flat[side]]) for side in (0, 1)]
        cuts = np.union1d(end[0], end[1])  # between two of them lies the overlap of one token of A and one of B
        link = (flat[0][np.searchsorted(end[0], cuts)] * self.size_b + flat[1][np.searchsorted(end[1], cuts)]).astype(self.kind)
        borders = np.intersect1d(end[0], end[1], assume_unique=True)
        last = np.cumsum([len(joined[0][k]) for k in good])
        to_link = np.searchsorted(cuts, last, "right").tolist()
        to_group = np.searchsorted(borders, last, "right")
        # Written out: by group, the ids of A, then those of B, each with what stands behind it.
        group = [np.searchsorted(borders, e) for e in end]
        sign = [np.where(np.append(g[1:] != g[:-1], True), end_sign, 0) for g, end_sign in zip(group, (1, 2), strict=True)]
        order = np.lexsort((np.concatenate([np.zeros(len(group[0])), np.ones(len(group[1]))]), np.concatenate(group)))
        signs = np.array([",", "|", ";"], dtype=object)[np.concatenate(sign)[order]]
        written = [f"{i}{c}" for i, c in zip(np.concatenate(flat)[order].tolist(), signs.tolist(), strict=True)]
        to_token = np.cumsum(sizes[0] + sizes[1]).tolist()
        n_groups = np.diff(to_group, prepend=0).tolist()
        raw, width, at, token = link.tobytes(), link.dtype.itemsize, 0, 0
        for j, k in enumerate(good):
            groups = "".join(written[token : to_token[j]])[:-1]
            out[k] = (len(ids[0][k]), len(ids[1][k]), n_groups[j], groups, raw[at * width : to_link[j] * width])
            at, token = to_link[j], to_token[j]
        return out

    def texts(self, texts: list[str]) -> list[tuple[int, int, int, int, str, bytes, bytes]]:
        """Per text: numbers of tokens, groups and links, the groups' digest, distinct linked pairs and how often each is linked."""
        number: dict[str, int] = defaultdict(count().__next__)
        at = [list(map(number.__getitem__, self.parts(t))) for t in texts]
        used = list(number)
        entry = list(map(self.known.get, used, repeat(0)))
        missing = [k for k, e in enumerate(entry) if e == 0]
        for k, found in zip(missing, self.align([used[k] for k in missing]) if missing else (), strict=True):
            entry[k] = found
            if len(self.known) < REMEMBERED:
                self.known[used[k]] = found
        none = (0, 0, 0, "", b"")
        n_a, n_b, n_groups, written, raw = zip(*[e or none for e in entry], strict=True)
        bad = np.array([e is None for e in entry])
        per_part = np.array((n_a, n_b, n_groups)).T
        codes, stop = np.frombuffer(b"".join(raw), dtype=self.kind), np.cumsum([len(x) for x in raw]) // np.dtype(self.kind).itemsize

        # All parts of all texts in a row; each text's distinct pairs lie together after the sort.
        size = np.array([len(x) for x in at])
        flat, text = np.fromiter(chain.from_iterable(at), dtype=np.int64, count=int(size.sum())), np.repeat(np.arange(len(at)), size)
        wrong = np.bincount(text, bad[flat], minlength=len(at)) > 0
        totals = np.stack([np.bincount(text, per_part[flat, k], minlength=len(at)).astype(np.int64) for k in range(3)], axis=1)
        own, times = np.unique(text * len(used) + flat, return_counts=True)
        text, part = own // len(used), own % len(used)
        links = np.diff(stop, prepend=0)[part]
        place = np.arange(links.sum()) + np.repeat(stop[part] - np.cumsum(links), links)
        weight, text, linked = np.repeat(times, links), np.repeat(text, links), codes[place]
        order = np.lexsort((linked, text))
        text, linked = text[order], linked[order]
        first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (linked[1:] != linked[:-1]))))
        often = np.add.reduceat(weight[order], first) if len(linked) else weight
        ends = np.searchsorted(text[first] if len(linked) else text, np.arange(len(at) + 1)).tolist()
        pairs, often = linked[first] if len(linked) else linked, often.astype("<u4")
        out = []
        for k, mine in enumerate(at):
            if wrong[k]:
                out.append((0, 0, 0, 0, "", b"", b""))
                continue
            lo, hi = ends[k], ends[k + 1]
            digest = sha256(";".join(map(written.__getitem__, mine)).encode()).hexdigest()
            out.append((*totals[k].tolist(), int(often[lo:hi].sum()), digest, pairs[lo:hi].tobytes(), often[lo:hi].tobytes()))
        return out


@cache
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _aligned(documents: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """A row per distinct text that is not empty: key, number of rows, measures, linked pairs."""
    texts = documents.select("text").filter("length(text) > 0").groupBy("text").agg(F.count(F.lit(1)).alias("weight"))
    rows = texts.select(common.row_key("text").alias("key"), "weight", "text").select("key.a", "key.b", "weight", "text")

    def work(columns: list[pa.Array]) -> dict[str, object]:
        both, found, held, size = _pair(*paths), [], [], 0
        for text in columns[3].to_pylist():
            held.append(text)
            size += len(text)
            if size > TOGETHER:
                found += both.texts(held)
                held, size = [], 0
        found += both.texts(held) if held else []
        n_a, n_b, n_groups, n_links, digest, pairs, times = zip(*found, strict=True)
        return {
            "ka": columns[0], "kb": columns[1], "weight": columns[2], "n_a": pa.array(n_a, pa.int64()), "n_b": pa.array(n_b, pa.int64()),
            "n_groups": pa.array(n_groups, pa.int64()), "n_links": pa.array(n_links, pa.int64()),
            "groups_sha256": pa.array(digest, pa.string()), "pairs": pa.array(pairs, pa.binary()), "times": pa.array(times, pa.binary()),
        }

    return common.map_columns(rows, ["a", "b", "weight", "text"], _ALIGNED, lambda c: work(c) if len(c[0]) else None)


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column in a row, and how many each row has."""
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), dtype=kind), np.array([len(x) for x in cells], dtype=np.int64) // np.dtype(kind).itemsize


def _counted(aligned: DataFrame, both: Pair) -> DataFrame:
    """(code, a, count, best) of every id pair: weights are summed in the task first; best where no pair of the A id has more."""
    kind = both.kind

    def work(columns: list[pa.Array]) -> dict[str, object]:
        codes, lengths = _flat(columns[1], kind)
        pairs, place = np.unique(codes, return_inverse=True)
        weight = np.repeat(columns[0].to_numpy(), lengths)
        total = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(total, place, weight)
        return {"code": pa.array(pairs.astype(np.int64)), "count": pa.array(total)}

    parts = common.map_columns(aligned, ["weight", "pairs"], "code long, count long", work)
    counts = parts.groupBy("code").agg(F.sum("count").alias("count"))
    counts = counts.withColumn("a", F.expr(f"code div {both.size_b}"))
    of_a = Window.partitionBy("a")  # at most as many rows as B has ids
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_a)).select("code", "a", "count", "best")


def _blocks(counts: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges [from, to) of A ids with at most ``most`` pairs together (or one A id); as many rows as A has ids are collected."""
    sizes = sorted((r.a, r.n) for r in counts.groupBy("a").agg(F.count(F.lit(1)).alias("n")).collect())
    cuts, held = [], 0
    for a, n in sizes:
        if not cuts or held + n > most:
            cuts.append(a)
            held = 0
        held += n
    return list(zip(cuts, [*cuts[1:], sizes[-1][0] + 1], strict=True)) if sizes else []


def _measured(aligned: DataFrame, counts: DataFrame, both: Pair, block: tuple[int, int], first: bool) -> DataFrame:
    """What the pairs of one block add to each text's measures; the first block brings what no count is needed for."""
    kind, low, high = both.kind, block[0] * both.size_b, block[1] * both.size_b
    found = counts.filter((F.col("a") >= block[0]) & (F.col("a") < block[1])).select("code", "count", "best").toArrow()
    code = found["code"].to_numpy()
    order = np.argsort(code)
    held = aligned.sparkSession.sparkContext.broadcast(
        (code[order], found["count"].to_numpy()[order], found["best"].to_numpy().astype(bool)[order])
    )

    def work(columns: list[pa.Array]) -> dict[str, object]:
        known, count, best = held.value
        codes, lengths = _flat(columns[7], kind)
        times = _flat(columns[8], "<u4")[0].astype(np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        inside = (codes >= low) & (codes < high)
        at, times, row = np.searchsorted(known, codes[inside].astype(np.int64)), times[inside], row[inside]
        n_best, count_sum = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        np.add.at(n_best, row, times * best[at])
        np.add.at(count_sum, row, times * count[at])
        own = [c if first else pa.array(np.zeros(len(lengths), dtype=np.int64)) for c in columns[2:6]]
        return {
            "ka": columns[0], "kb": columns[1], **dict(zip(_MEASURES[:4], own, strict=True)), "groups_sha256": columns[6],
            "n_best": pa.array(n_best), "count_sum": pa.array(count_sum),
        }

    columns = ["ka", "kb", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    schema = "ka long, kb long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return common.map_columns(aligned, columns, schema, work)


def pair_counts(documents: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """(a, b, count, best): in how many documents an id pair is linked, and whether no pair of that A id has a higher count."""
    paths = tokenizers or default_tokenizers()
    both = _pair(*paths)
    counts = _counted(_aligned(documents, paths), both)
    return counts.select("a", F.expr(f"code % {both.size_b}").alias("b"), "count", "best")


def align(documents: DataFrame, tokenizers: tuple[str, str] | None = None, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null or empty, or whose token bytes differ from a space and the text, have no tokens: zeros and '' as
    digest; they count for no pair. Rows that repeat count each. Special tokens' strings are plain text. Ties for an A
    id's highest count are all best. An empty table gives an empty result. Only doc_id and text are read.
    """
    paths = tokenizers or default_tokenizers()
    both = _pair(*paths)
    aligned = common.stored(_aligned(documents, paths))
    counts = common.stored(_counted(aligned, both))
    blocks = _blocks(counts, block_pairs) or [(0, 0)]
    parts = [_measured(aligned, counts, both, block, not i) for i, block in enumerate(blocks)]
    summed = reduce(DataFrame.unionAll, parts).groupBy("ka", "kb").agg(
        *[F.sum(c).alias(c) for c in _MEASURES], F.max("groups_sha256").alias("groups_sha256")
    )
    rows = documents.select("doc_id", common.row_key("text").alias("key")).select("doc_id", F.col("key.a").alias("ka"), F.col("key.b").alias("kb"))
    zeros = {c: 0 for c in _MEASURES} | {"groups_sha256": ""}
    return rows.join(summed, ["ka", "kb"], "left").select("doc_id", *_MEASURES, "groups_sha256").fillna(zeros, list(zeros))
