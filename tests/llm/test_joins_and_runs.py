"""The joins and searches on whole texts against plain versions."""

from __future__ import annotations

import os
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lintlake.llm import alignment, ngram_join, periodic, queries
from lintlake.llm.parity import Parities, folded, parities

AZ = {k: k + 32 for k in range(65, 91)}
SF = "/root/testdata/sf0.001"
WORD = "[^\x20\x09-\x0d]+"


def by_row(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


# ---- periodic runs


def plain_runs(w, shortest=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] is not None and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(shortest, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def runs_of(w, shortest=12):
    names = {}
    ids = [names.setdefault(x, len(names)) for x in w]
    return [tuple(map(int, r)) for r in zip(*periodic.find_runs(np.array([*ids, -1]), shortest), strict=True)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=90), st.integers(1, 4), st.lists(st.integers(0, 2), max_size=40))
def test_runs_of_small_alphabets(block, times, tail):
    w = block * times + tail
    assert runs_of(w) == plain_runs(w)
    assert runs_of(w, 2) == plain_runs(w, 2)


def test_runs_of_built_words():
    """Runs inside runs, touching regions with one small period, Fibonacci and Thue-Morse words, long and exact squares."""
    rng = random.Random(3)
    a, b = "a", "ab"
    for _ in range(12):
        a, b = b, b + a
    thue = "".join(str(bin(i).count("1") % 2) for i in range(600))
    cases = [b[:700], thue, "x" * 500, ("ab" * 40 + "a") * 2, ("ab" * 40 + "a") * 5, ("a" * 30 + "b") * 2, ("a" * 30 + "b") * 9]
    for _ in range(120):
        inner = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 5)))
        word = inner * rng.randrange(1, 30) + inner[: rng.randrange(len(inner))] + "".join(rng.choice("abc") for _ in range(rng.randrange(3)))
        cases.append("".join(rng.choice("abc") for _ in range(rng.randrange(20))) + word * rng.randrange(2, 5) + word[: rng.randrange(len(word))])
    for _ in range(40):
        half = [rng.randrange(10**6) for _ in range(rng.randrange(6, 300))]
        cases.append([*range(-50, -1), *half, *half, 7])
    for case in cases:
        w = list(case)
        assert runs_of(w) == plain_runs(w)
    chunks = [list(c) for c in cases]
    n_runs, table, _ = periodic._of_chunk([[str(x).encode() for x in c] for c in chunks], 12)
    want = [plain_runs(c) for c in chunks]
    assert n_runs == [len(x) for x in want]
    assert [tuple(r) for r in table.tolist()] == [r for x in want for r in x]


def planted(doc_id, w):
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 or not w:
        return w
    a, n = g % len(w), len(w)
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def plain_digest(doc_id, text):
    w = planted(doc_id, re.findall(WORD, text or ""))
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    s, n, q = min(((s, n, q) for s, n, q in runs), key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    return (
        doc_id, len(runs), s, n, q, 1000 * n // q if runs else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        digest(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periodic_runs(documents, corpus, spark):
    def short(rows):
        return [r for r in rows if len(r[1] or "") < 30_000]

    extra = [(i, "a b c d " * 5 + "x", None, None, None, None, None, None, None, None) for i in range(100, 160)]
    df = spark.createDataFrame(short(corpus) + extra, documents.schema)
    got = periodic.run_digest(periodic.periodic_runs(periodic.with_planted_period(df)))
    assert by_row(got, *RUN_COLUMNS) == Counter(plain_digest(r[0], r[1]) for r in short(corpus) + extra)


def test_periodic_runs_of_given_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 12000").collect()
    got = {r.doc_id: tuple(r[c] for c in RUN_COLUMNS) for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(rows) > 150
    for r in rows:
        assert got[r.doc_id] == plain_digest(r.doc_id, r.text)


def test_periodic_runs_of_long_texts_and_empty_tables(spark, empty):
    w = ["a"] * 300_000
    assert runs_of(w) == [(0, 300_000, 1)]
    assert periodic.run_digest(periodic.periodic_runs(periodic.with_planted_period(empty))).count() == 0
    assert by_row(periodic.periodic_runs(empty.union(empty)), "doc_id") == Counter()


# ---- n-gram join


def plain_join(rows, n=4, percent=85):
    sets = []
    for i, t, *_ in rows:
        w = re.findall(WORD, (t or "").translate(AZ))
        m = min(n, len(w))
        sets.append((float("inf") if i is None else i, {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()))
    holders = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for g in s:
            holders[g].add(k)
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k, (_, s) in enumerate(sets):
        shared = Counter(j for g in s for j in holders[g] if j < k)
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                root[find(k)] = find(j)
    least = defaultdict(lambda: float("inf"))
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least[find(k)], i)
    real = lambda i: None if i == float("inf") else i
    return Counter((real(i), len(s), real(least[find(k)])) for k, (i, s) in enumerate(sets))


JOIN_COLUMNS = ("doc_id", "n_shingles", "component_id")


def near_rows(seed, n):
    """Many sets around the threshold: edits at random places and at the end, tiny texts, shared feet."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out, foot = [], " ".join(f"foot{i}" for i in range(30))
    for _ in range(n // 12):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 18, 25, 40, 70, 120, 260, 520]))]
        for k in range(8):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 40 + (k > 4))):
                w[rng.randrange(len(w))] = rng.choice(words)
            cut = rng.randrange(1 + len(w) // 20 + (k % 2))
            out.append(" ".join(w[: len(w) - cut] or w))
        out += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) + " " + foot for _ in range(4)]
    rng.shuffle(out)
    return [(i * 2, t, None, None, None, None, None, None, None, None) for i, t in enumerate(out)]


def test_ngram_join(documents, corpus):
    assert by_row(ngram_join.ngram_components(documents), *JOIN_COLUMNS) == plain_join(corpus)


@pytest.mark.parametrize(("seed", "held"), [(1, 512), (2, 3)])
def test_ngram_join_near_the_threshold(spark, documents, monkeypatch, seed, held):
    monkeypatch.setattr(ngram_join, "HELD", held)
    monkeypatch.setattr(ngram_join, "ASKS", held)
    rows = near_rows(seed, 1200)
    df = spark.createDataFrame(rows, documents.schema)
    assert by_row(ngram_join.ngram_components(df), *JOIN_COLUMNS) == plain_join(rows)


def test_equal_groups_are_compared_once(spark, documents):
    """Of the signatures that the very same sets have, one is kept: a pair of near copies is no row for each of them."""
    words = [f"w{i}" for i in range(900)]
    rows = [(k, " ".join([*words[:800], f"end{k}"]), None, None, None, None, None, None, None, None) for k in range(6)]
    signed = ngram_join._signed(spark.createDataFrame(rows, documents.schema))
    holders = defaultdict(set)
    for r in ngram_join._members(signed).collect():
        holders[r.signature].add(r.id)
    assert len(holders) == len(set(map(frozenset, holders.values()))) < 10


def test_last_round_makes_few_pairs(spark, documents, monkeypatch):
    """Where the rounds before have connected nothing, the last one connects all copies, by a link for each and not by all pairs."""
    words = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join([*words, f"end{k}"]), None, None, None, None, None, None, None, None) for k in range(40)]
    confirmed, asked = ngram_join._confirmed, []

    def late(pairs, pieces):
        asked.append(pairs.count())
        return confirmed(pairs, pieces) if len(asked) == 3 else confirmed(pairs, pieces).filter("false")

    monkeypatch.setattr(ngram_join, "_confirmed", late)
    df = spark.createDataFrame(rows, documents.schema)
    assert by_row(ngram_join.ngram_components(df), *JOIN_COLUMNS) == plain_join(rows)
    assert len(asked) == 3 and asked[-1] < 40


def test_linked_sets_share_a_signature():
    """Every pair at or above the threshold, however its shingles lie, has a common signature and passes the parities."""
    rng = np.random.default_rng(7)
    for _ in range(4000):
        n = int(rng.choice([6, 7, 8, 9, 10, 12, 15, 16, 20, 31, 32, 40, 63, 64, 90, 127, 128, 200, 255, 300, 511, 700]))
        base = rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        gone, new = rng.integers(0, n // 5 + 2, 2)
        x, y = np.unique(base[:n]), np.unique(base[gone : n + new])
        both = len(np.intersect1d(x, y))
        if x.tobytes() != y.tobytes() and 100 * both >= 85 * (len(x) + len(y) - both):
            assert len(np.intersect1d(ngram_join.signatures(x), ngram_join.signatures(y)))
            d = len(x) + len(y) - 2 * both
            assert d <= ngram_join.most_different(len(x), len(y))
            a, b = parities(x), parities(y)
            width = min(len(a), len(b))
            gap = np.bitwise_count(folded([a], width) ^ folded([b], width)).sum()
            assert gap <= d and Parities([a, b]).gaps(np.array([0, 1]), np.array([1, 0])).tolist() == [gap, gap]


def test_ngram_join_of_empty_tables(empty):
    assert ngram_join.ngram_components(empty).count() == 0


# ---- alignment


def plain_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(alignment.default_tokenizers()[0])
    whole.encode_special_tokens = True
    return whole


def plain_alignment(rows):
    both, whole_a = alignment.Pair(*alignment.default_tokenizers()), plain_tokenizer()
    per_doc, counts = [], Counter()
    for i, text, *_ in rows:
        whole = " " + (text or "")
        ids_a, ids_b = whole_a.encode(whole, add_special_tokens=False).ids, both.b.encode(text or "")
        bytes_a, bytes_b = [both.bytes_a[t] for t in ids_a], [both.bytes_b[t] for t in ids_b]
        if not text or b"".join(bytes_a) != whole.encode() or b"".join(bytes_b) != whole.encode():
            per_doc.append((i, 0, 0, [], ""))
            continue
        links, groups, at, j, pos = [], [([], [])], 0, 0, 0
        spans_a, spans_b = [], []
        for ids, parts, spans in ((ids_a, bytes_a, spans_a), (ids_b, bytes_b, spans_b)):
            at = 0
            for t, x in zip(ids, parts, strict=True):
                spans.append((at, at + len(x), t))
                at += len(x)
        ends = {e for _, e, _ in spans_a} & {e for _, e, _ in spans_b}
        for kind, spans in ((0, spans_a), (1, spans_b)):
            at = 0
            for _, e, t in spans:
                while len(groups) <= at:
                    groups.append(([], []))
                groups[at][kind].append(t)
                at += e in ends
        j = 0
        for s, e, t in spans_a:
            while spans_b[j][1] <= s:
                j += 1
            k = j
            while k < len(spans_b) and spans_b[k][0] < e:
                links.append((t, spans_b[k][2]))
                k += 1
        del pos
        counts.update(set(links))
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        per_doc.append((i, len(ids_a), len(ids_b), links, written))
    best = Counter()
    for (t, _), n in counts.items():
        best[t] = max(best[t], n)
    return Counter(
        (i, n_a, n_b, 1 + w.count(";") if w else 0, len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), digest(w) if w else "")
        for i, n_a, n_b, links, w in per_doc
    )


ALIGN_COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    "<|endoftext|> and <s> </s> <unk> <0x41>", "a  b   c", " lead", "trail ", "\n\nline\n\n \nnext\tTab\r\nx", "▁under▁score", "ﬁ ½ é ´é", "nul\x00byte",
    " hard space   sep\x1c\x1f x", "日本語のテキスト 🙂👍🏽 mixed", "it's we'll 'd  I'm", "x" * 3000, "1234567890 " * 50, "\n", " ", "a\n", "\na", "\x85 \x85\n\x85 b", "a ́b", "👩‍👩‍👧 ​ z﻿",
]


def test_alignment(spark, documents, corpus):
    rows = corpus + [(900 + i, t, *[None] * 8) for i, t in enumerate(ODD + ODD[:3])]
    df = spark.createDataFrame(rows, documents.schema)
    want = plain_alignment(rows)
    assert by_row(alignment.align(df), *ALIGN_COLUMNS) == want
    assert by_row(alignment.align(df, block_pairs=50), *ALIGN_COLUMNS) == want


def test_alignment_of_given_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert by_row(queries.op11_tokenizer_alignment(spark, SF), *ALIGN_COLUMNS) == plain_alignment([tuple(r) for r in rows])


def test_parts_encode_as_whole_texts():
    """Tokens of the parts, one after another, are the tokens of the whole text (sf0.01 and odd texts)."""
    import duckdb

    folder = "/root/testdata/sf0.01/documents.parquet"
    texts = [t for (t,) in duckdb.sql(f"select text from '{folder}'").fetchall()] if os.path.exists(folder) else []
    both, whole_a = alignment.Pair(*alignment.default_tokenizers()), plain_tokenizer()
    rng = random.Random(4)
    texts += ODD + ["".join(rng.choice(["a", "Ber", " ", "\n", "'s", "1", "é", ".", "\t", "▁", "日", " "]) for _ in range(40)) for _ in range(500)]
    for text in filter(None, texts):
        ids_a, ids_b = both.ids(both.parts(text))
        assert sum(ids_a, []) == whole_a.encode(" " + text, add_special_tokens=False).ids
        if "▁" not in text:
            assert sum(ids_b, []) == both.b.encode(text)


def test_alignment_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    both = alignment.Pair(*alignment.default_tokenizers())
    first = [both.texts([t])[0] for t in ("one two three", "four five six", "one two three", "▁ one")]
    assert first[0] == first[2] and len(both.known) == 3 and first[3] == (0, 0, 0, 0, "", b"", b"")
    assert both.texts(["one two three", "four five six"]) == first[:2]


def test_empty_table(empty):
    assert alignment.align(empty).count() == 0
    assert alignment.pair_counts(empty).count() == 0
