"""Operators against plain versions on a small corpus with nulls, empty, long and repeated texts and clashing columns."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from lintlake.llm import common, components, decontaminate, fingerprints, line_dedup, near_dedup, pii, repeats

AZ = {k: k + 32 for k in range(65, 91)}


def digest(data: str | bytes) -> str:
    return sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def by_row(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# ---- near duplicates


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(AZ))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_components(corpus):
    sets = [(i if i is not None else float("inf"), shingles(t)) for i, t, *_ in corpus]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                i_, j_ = find(i), find(j)
                root[max(i_, j_)] = min(i_, j_)
    real = lambda i: None if i == float("inf") else i
    return Counter((real(i), len(s), real(find(i)), find(i) == i) for i, s in sets)


def test_near_duplicates(documents, corpus):
    got = by_row(near_dedup.near_duplicates(documents), "doc_id", "n_shingles", "component_id", "kept")
    assert got == plain_components(corpus)


def test_small_tables_take_few_tasks(spark, monkeypatch):
    """A round of components over few links is no file, and no task, for each shuffle partition."""
    settings = {"spark.sql.shuffle.partitions": "41", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, files, stored = {k: spark.conf.get(k) for k in settings}, [], common.stored

    def seen(df, *rows):
        files.append(len((found := stored(df, *rows)).inputFiles()))
        return found

    monkeypatch.setattr(common, "stored", seen)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        named = components.components(spark.range(2000).selectExpr("id AS x", "id + 1 - id % 2 AS y"))
        assert max(files) <= 3 * spark.sparkContext.defaultParallelism
        assert {(r.id, r.component) for r in named.collect()} == {(i, i - i % 2) for i in range(2000)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_near_duplicates_in_large_nodes(documents, corpus, monkeypatch):
    """Branching, random parts and blocks are used when nodes may hold few members."""
    for levels in (6, 1):
        monkeypatch.setattr(near_dedup, "SMALL", 3)
        monkeypatch.setattr(near_dedup, "COMPARISONS", 1)
        monkeypatch.setattr(near_dedup, "LEVELS", levels)
        got = by_row(near_dedup.near_duplicates(documents), "doc_id", "n_shingles", "component_id", "kept")
        assert got == plain_components(corpus)


def test_representatives_keep_columns(documents, corpus):
    got = near_dedup.representatives(documents)
    assert got.dtypes == documents.dtypes
    want = {i for (i, _, _, kept), _ in plain_components(corpus).items() if kept}
    assert {r.doc_id for r in got.collect()} == want


# ---- repeated strings


def plain_repeats(corpus):
    texts = [(i, (t or "").encode()) for i, t, *_ in corpus]
    seen = Counter(t[p : p + 200] for _, t in texts for p in range(len(t) - 199))
    out = Counter()
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = [True] * 200
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[(i, len(t), sum(gone), runs, digest(kept))] += 1
    return out


@pytest.mark.parametrize("limit", [repeats.MERGE_UNITS, 0])
def test_repeats(documents, corpus, monkeypatch, limit):
    monkeypatch.setattr(repeats, "MERGE_UNITS", limit)
    got = by_row(repeats.without_repeats(documents), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == plain_repeats(corpus)


def test_repeats_across_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 256)
    text = "".join(chr(97 + (i * i * 7 + i // 3) % 23) for i in range(1500))
    rows = [(1, text), (2, "q" * 300), (3, "z" + text[100:700] + "end"), (4, text[400:650])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_row(repeats.without_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == plain_repeats(rows)


def test_repeats_of_texts_without_ids(spark):
    """Texts without an id whose 32-bit hashes are equal are two texts."""
    rows = [(None, "a" * 230 + str(k)) for k in range(3)] + [(None, None), (None, "b" * 199), (4, "c" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_row(repeats.without_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == plain_repeats(rows)


# ---- personal data


def test_personal_data_of_long_words():
    """A list of addresses without spaces, and a long chain of numbers, take memory and time by their length."""
    text = ",".join(f"user{k}@example{k % 50}.com" for k in range(40_000))
    seen = pii._occurrences(text, pii.base_spans(text))
    assert len(seen) == 40_000 and sum(len(p) for o in seen for p in o[4]) < 300 * len(seen)
    chain = "1." * 100_000
    assert len(pii._occurrences(chain, pii.base_spans(chain))) >= 25_000


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


HARD = [
    "a@b.c@d.e @x.y a@b a.b+c%d_e-f@g-h.i.j.k!", "é@ü.de x@y.z.", "1.2.3.4 01.002.0003.255 1.2.3.256 1.2.3.4.5.6.7.8 999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 0000 0000 0000", "+1 (724) 555-7058 +49.30.1234567 +12 +1234567890123456 ++1 5555 55555",
    "ß" * 50 + "4111111111111111" + "x@" * 20 + "y.z", "1" * 400 + "." + "2" * 400, "@" * 300 + "a.b", "+1" * 200,
]


def test_base_spans():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    for text in HARD:
        assert pii.base_spans(text) == plain_spans(text), text


def test_personal_data_and_bootstrapping(spark):
    texts = [*HARD, None, ""]
    texts += [f"lorem {w} please call my desk at +1 (724) 555-70{k} today or later" for k, w in enumerate("ab cd ef gh ij kl mn op".split(), 10)]
    texts += ["ipsum please call my desk at 724-555-7099 today or later", "in the year 724-555-70 it was"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_row(pii.find(df), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = Counter()
    for i, t in rows:
        spans = plain_spans(t or "")
        want[(i, *(sum(k == x for _, x, _ in spans) for k in range(4)), digest(pii.span_text(spans)))] += 1
    assert got == want
    spans = {r.doc_id: r.spans for r in pii.find(df).collect()}
    found = texts.index("ipsum please call my desk at 724-555-7099 today or later")
    assert spans[found] == "phone:29:41" and spans[found + 1] == ""
    assert spans[3] == pii.span_text(plain_spans(texts[3]))


# ---- decontamination


def plain_hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    lengths = {len(k) for k in windows}
    out = Counter()
    for i, t, *_ in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                got = windows.get(tuple(w[k : k + n]))
                if got:
                    hit |= set(range(k, k + n))
                    found |= got
        ids = ",".join(sorted(str(x) for x in found))
        out[(i, len(w), len(hit), len(found), digest(ids), bool(hit) and 20 * len(hit) >= len(w))] += 1
    return out


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 400])
def test_decontamination(spark, documents, corpus, block_bytes):
    items = [(1, corpus[8][1]), (2, "A b, C D!"), (3, None), (4, "...;"), (5, corpus[30][1]), (5, corpus[31][1]), (6, "edit5"), (7, "ü" * 3)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = decontaminate.benchmark_hits(documents, bench, block_bytes=block_bytes)
    got = by_row(decontaminate.contamination(hits), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = plain_hits(corpus, items)
    assert got == want
    clean = decontaminate.clean_documents(documents, bench, block_bytes)
    assert clean.dtypes == documents.dtypes
    bad = {k[0] for k in want if k[-1]}
    assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, *_ in corpus if i not in bad)


# ---- line dedup


def test_line_dedup(documents, corpus):
    sites, contents, first = defaultdict(set), defaultdict(set), {}
    for r in corpus:
        for i, x in enumerate((r[1] or "").split("\n")):
            norm = x.strip(" ").lower()
            sites[norm].add(r[3] or "")
            contents[norm].add(r[1])
            first[norm] = min(first.get(norm, (float("inf"), 0)), (float("inf") if r[0] is None else r[0], i))
    want = Counter()
    for r in corpus:
        lines = (r[1] or "").split("\n")
        wide = lambda n: n and len(sites[n]) >= 10 and len(contents[n]) >= 10
        norms = [x.strip(" ").lower() for x in lines]
        bad = [i for i, n in enumerate(norms) if wide(n) and (r[0], i) != first[n]]
        want[(r[0], len(lines), len(bad), digest("\n".join(x for i, x in enumerate(lines) if i not in bad)))] += 1
    got = by_row(line_dedup.line_report(documents), "doc_id", "n_lines", "n_removed", "kept_sha256")
    assert got == want and sum(k[2] for k in want) >= 13
    cleaned = line_dedup.clean_documents(documents)
    assert cleaned.dtypes == documents.dtypes and cleaned.count() == len(corpus)


# ---- fingerprints


def test_fingerprints(documents, corpus):
    got = fingerprints.edited_likeness(documents).collect()
    assert len(got) == len(corpus)
    order = sorted({(i if i is not None else float("inf"), t or "") for i, t, *_ in corpus})
    assert len({i for i, _ in order}) == len(order)
    following = {a: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}
    prints = defaultdict(set)
    for r in got:
        key = next(k for k in order if k[0] == (r.doc_id if r.doc_id is not None else float("inf")))
        text, n = key[1], len(key[1]) // 4
        edited = text[: len(text) - n] + following[key][:n]
        assert (r.n_chars, r.edited_sha256) == (len(text), digest(edited))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints[text].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    long = [r for r in got if r.n_chars > 400 and r.doc_id != 18]
    assert min(r.near_edited for r in long) > 0.3


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert near_dedup.near_duplicates(empty).count() == 0
    assert repeats.without_repeats(empty).count() == 0
    assert pii.find(empty).count() == 0
    assert decontaminate.contamination(decontaminate.benchmark_hits(empty, bench)).count() == 0
    assert decontaminate.clean_documents(empty, bench).count() == 0
    assert line_dedup.line_report(empty).count() == 0
    assert fingerprints.edited_likeness(empty).count() == 0
