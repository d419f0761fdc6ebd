"""Classifiers against held-out rows, packing by round trip, the pipeline stage by stage."""

from __future__ import annotations

import random
import re
from array import array
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lintlake.llm import language_id, license_scan, packing, toxicity
from lintlake.llm.common import table
from tests.llm.test_exact import plain_components, plain_hits

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# ---- packing


def plain_best_fit(lengths, capacity):
    """Bins of best-fit decreasing, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fitting:
            rooms[min(fitting)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 100, 1024])
    lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, max(1, capacity // 5))]) for _ in range(rng.randint(1, 400))]
    rooms = defaultdict(lambda: capacity)
    for length, _, first, each, offset in (plan := packing.best_fit_plan(dict(Counter(lengths)), capacity)):
        assert 0 <= offset and each * length <= capacity - offset
    ranks = defaultdict(int)
    steps = defaultdict(list)
    for step in plan:
        steps[step[0]].append(step)
    for length in sorted(set(lengths), reverse=True):
        for _ in range(lengths.count(length)):
            rank = ranks[length]
            ranks[length] += 1
            _, start, first, each, offset = [s for s in steps[length] if s[1] <= rank][-1]
            at = first + (rank - start) // each
            assert rooms[at] == capacity - offset - (rank - start) % each * length
            rooms[at] -= length
    assert sorted(rooms.values()) == plain_best_fit(lengths, capacity)


def test_tokens_are_the_tokenizers():
    from tokenizers import Tokenizer

    path, ranks = packing.default_tokenizer()
    plain, fast = Tokenizer.from_file(path), packing.Encoder(path, ranks)
    texts = [
        "", " ", "a", "a  b", "a \n b", "x\n\n y", " lead", "trail ", "tab\tone", "it's we'll", "don t  x", "é ü ñ 漢字 1234 ...",
        "a<|endoftext|>b", "word " * 50, "  z", "I'm  'll", "z" * 3000, "1 22 333 4444 !!! ??",
    ]
    for text in texts:
        for _ in range(2):
            assert list(array("I", fast(text))) == plain.encode(text, add_special_tokens=False).ids, text


def test_packing_round_trip(documents, corpus, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer()[0])
    ids = lambda t: plain.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]
    want = Counter()
    for doc_id, text, *_ in corpus:
        mine = ids(text)
        for k, (start, n) in enumerate(packing.pieces_of(len(mine))):
            assert n == 1024 or k == 0
            want[(doc_id, k, start, n, crc32(array("I", mine[start : start + n]).tobytes()))] += 1
    rows = packing.pack(documents).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(bins) == len(plain_best_fit([k[3] for k in want.elements()], 1024))
    assert packing.pack(empty).count() == 0


# ---- classifiers


def test_toxicity(spark, empty):
    d = "/root/testdata/sf0.1"
    labels = table(spark, d, "labels")
    got = toxicity.toxicity(table(spark, d, "documents"), labels).join(labels, "doc_id").filter("held_out")
    counts = {(r.predicted, r.toxic): r["count"] for r in got.groupBy("predicted", "toxic").count().collect()}
    hit, false, missed = counts.get((1, 1), 0), counts.get((1, 0), 0), counts.get((0, 1), 0)
    assert hit / (hit + false) > 0.95 and hit / (hit + missed) > 0.8
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "idiot " * 9), (3, "x" * 200000), (3, "x" * 200000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd, none).collect()
    assert len(rows) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    assert toxicity.toxicity(empty, none).count() == 0


def test_language(spark):
    pages = table(spark, MIDDLE, "pages")
    documents = table(spark, MIDDLE, "documents")
    truth = F.regexp_extract("url", "/([a-z]{2})/", 1)
    # Without any declaration the text, suffix and host decide.
    bare = pages.withColumn("html", F.regexp_replace("html", 'lang="[a-z]+"', "")).withColumn("truth", truth)
    got = language_id.identify(bare, documents).join(bare.select("page_id", "truth"), "page_id")
    right = got.filter("lang = truth").count() / pages.count()
    assert right > 0.95
    odd = spark.createDataFrame(
        [(1, None, None), (2, "", ""), (2, "", ""), (3, "not a url", "<html lang='de'>"), (None, "http://h.de/x", "<p>der die das</p>")],
        "page_id long, url string, html string",
    )
    rows = language_id.identify(odd, documents).collect()
    assert len(rows) == 5 and all(r.lang is not None and 0 < r.probability <= 1 for r in rows)
    assert language_id.identify(odd.limit(0), documents).count() == 0
    assert all(r.lang is None for r in language_id.identify(odd, documents.limit(0)).collect())


def test_many_languages(spark):
    """Seventy languages, most of them rare, are all told apart; unclosed elements cost their length once."""
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"x{k:02d}": ["".join(rng.choice(letters) for _ in range(6)) for _ in range(40)] for k in range(70)}
    text = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    rows = [(k * 100 + i, text(x, 60), x, None, None, "clash") for k, x in enumerate(words) for i in range(400 if k < 3 else 3)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, affix string")
    pages = [(k, f"http://h{k}.org/a", f"<p>{text(x, 30)}</p>", "clash") for k, x in enumerate(words)]
    pages.append((99, None, "<script> " * 60_000 + "<!-- " * 60_000))
    got = {r.page_id: r.lang for r in language_id.identify(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string"), documents).collect()}
    assert len(got) == 71 and sum(got[k] == x for k, x in enumerate(words)) >= 69


def test_lines_that_are_not_classified():
    """Every word triple of a template has an anchor."""
    import re

    anchors = license_scan.anchor_words()
    for texts in license_scan.TEMPLATES.values():
        for t in texts:
            w = [x for x in re.split(r"[^a-z0-9.]+|\.(?![0-9])", t.lower()) if x]
            assert all(anchors & set(w[i : i + 3]) for i in range(max(1, len(w) - 2)))


def test_suspects_lose_no_statement(spark):
    """The scan of all lines and that of lines with a suspect word find the same statements; a block of 6,000 lines ends."""
    documents = table(spark, SMALL, "documents").select("doc_id", "text")
    extra = [(10**6, "\n".join(["use of this source code is"] * 6000)), (10**6 + 1, "Mit license, all rights"), (10**6 + 2, "the of in and by or")]
    documents = documents.unionByName(spark.createDataFrame(extra, documents.schema))
    scanner = license_scan.fit(documents)
    assert scanner.suspects() is not None
    some = license_scan.statements(documents, scanner).drop("confidence", "share").collect()
    scanner.suspects = lambda: None
    assert Counter(some) == Counter(license_scan.statements(documents, scanner).drop("confidence", "share").collect())


def test_texts_are_not_shuffled_for_wrapped_notices(spark, monkeypatch):
    """The documents that are read again are few, and planning knows it: the join broadcasts their names, not by a hint."""
    documents = table(spark, MIDDLE, "documents").select("doc_id", "text")
    plans, named = [], license_scan._named

    def seen(documents, asked):
        found = named(documents, asked)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(license_scan, "_named", seen)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32k")
    try:
        license_scan.wrapped(documents)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]


KNOWN = {
    "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "All rights reserved.": "proprietary",
}


def test_licenses(spark):
    documents = table(spark, MIDDLE, "documents")
    extra = spark.createDataFrame(
        [(900001, None), (900002, ""), (900003, "Licensed under the Wombat Permissive Terms, edition 9."), (900004, "MIT\n\nReleased under the MIT License.")] * 2,
        "doc_id long, text string",
    )
    both = documents.select("doc_id", "text").unionByName(extra)
    got = {r.doc_id: r for r in license_scan.license_report(both).collect()}
    wrong = 0
    for r in both.collect():
        want = ",".join(sorted({KNOWN[x] for x in (r.text or "").split("\n") if x in KNOWN}))
        wrong += ",".join(f for f in got[r.doc_id].families.split(",") if f != "unknown") != want
    assert wrong <= 2 and len(got) == 1004
    assert got[900003].families in ("", "unknown") and got[900001].n_statements == 0
    assert license_scan.license_report(documents.limit(0)).count() == 0


# ---- pipeline


def test_pipeline(spark):
    docs = table(spark, SMALL, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL).cache()
        seen[name] = (docs.collect(), out.collect())
        if name != "packing":
            assert out.dtypes == docs.dtypes
        docs = out
    as_rows = lambda rows: [(r.doc_id, r.text) for r in rows]
    before, after = seen["toxicity"]
    assert {r.doc_id for r in after} < {r.doc_id for r in before}
    before, after = seen["line_dedup"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    before, after = seen["near_dedup"]
    kept = {k[0] for k in plain_components(as_rows(before)) if k[3]}
    assert sorted(r.doc_id for r in after) == sorted(kept)
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    assert sorted(r.doc_id for r in after) == sorted(k[0] for k in plain_hits(as_rows(before), items) if not k[5])
    before, after = seen["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    again = Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, SMALL).collect())
    assert again == Counter(tuple(r)[:5] for r in after)
    assert all(re.fullmatch(r"\w+", name) for name in seen)
