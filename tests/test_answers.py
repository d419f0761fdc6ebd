"""Answers entry by entry, against plain Python on ``json.loads``."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lintlake.functions.ranking import _ranged, within_budget
from lintlake.operators import answers, patches
from lintlake.plans import catalog
from tests.test_jobs import FINDINGS_SCHEMA, files_of, finding

PIECES = [
    {"index": 1, "valid": True, "reason": "ok"}, {"index": 2, "valid": False}, {"index": 2}, {"index": 3, "valid": None},
    {"index": 1, "improved_suggestion": "better"}, {"index": 9, "valid": True}, {"index": 3, "valid": "no", "reason": "ré\n\"q\""},
    {"index": 2, "valid": 0}, {"index": 2, "valid": 0.5}, {"index": 1, "valid": []}, {"index": 1, "valid": {"a": 1}}, {"index": 3, "valid": ""},
    {"valid": False}, {"index": "2", "valid": False}, {"index": 1.5}, {"index": None}, 7, "text", None, [{"index": 1, "valid": False}], {},
]


def judged(reply: str, n: int) -> list[tuple[int, str, str]]:
    """(finding number, suggestion, description) of n findings after one answer."""
    keep = [(i, "s", "d") for i in range(1, n + 1)]
    try:
        entries = json.loads(reply)
    except ValueError:
        return keep
    if not isinstance(entries, list):
        return keep
    good = [e for e in entries if isinstance(e, dict) and type(e.get("index")) is int]
    rows = [r for r in keep if len(good) < len(entries) and all(e["index"] != r[0] for e in good)]
    for e in good:
        if 1 <= e["index"] <= n and e.get("valid", True):
            rows.append((e["index"], e.get("improved_suggestion") or "s", f"d [AI: {e.get('reason') or ''}]"))
    return rows


def test_each_verdict_stands_alone(spark):
    rng = random.Random(11)
    replies = ["[]", "{}", "7", "null", '["a"]', "[1, 2", '{"index": 1}', '[{"index": 1}', "[" * 2000, json.dumps([7]), ""]
    replies += [json.dumps(rng.choices(PIECES, k=rng.randrange(1, 6)), ensure_ascii=rng.random() < 0.5) for _ in range(150)]
    replies.append(json.dumps(PIECES * 3000))
    names = [f"f{i:03d}" for i in range(len(replies))]
    found = spark.createDataFrame(
        [finding("r", "Clarity", "low", f, sub=i, title=f"{f}:{i + 1}") for f in names for i in range(3)], FINDINGS_SCHEMA)
    answered = spark.createDataFrame([("r", *p) for p in zip(names, replies)], "repo string, key string, text string")
    kept = answers.validated(found, files_of(spark, [("r", f, "text") for f in names]), answered).collect()
    got = sorted((r["title"], r["suggestion"], r["description"]) for r in kept)
    assert got == sorted((f"{f}:{i}", s, d) for f, reply in zip(names, replies) for i, s, d in judged(reply, 3))


def test_review_and_patches_skip_broken_entries(spark):
    reply = json.dumps([3, {"title": "A", "line": "x"}, None, {"file": "f", "line": 4, "extra": {"deep": [1]}}, "s"])
    rows = spark.createDataFrame([("r", reply), ("s", None), ("t", "")], "repo string, text string")
    got = [(r["repo"], r["file"], r["title"], r["line"]) for r in answers.review_findings(rows).orderBy("ord").collect()]
    assert got == [("r", "(unknown)", "A", None), ("r", "f", "AI Finding", 4)]

    found = spark.createDataFrame([finding("r", "Clarity", "high", "a.py", sub=0, title="first")], FINDINGS_SCHEMA)
    reply = json.dumps([{"original": 5}, [], {"finding_index": 1, "original": "one", "fixed": "1"}, {"fixed": "no original"}])
    answered = spark.createDataFrame([("r", "a.py", reply)], "repo string, key string, text string")
    made = patches.proposed(found, files_of(spark, [("r", "a.py", "one two")]), answered).collect()
    assert [(p["seq"], p["finding"], p["original"], p["fixed"]) for p in made] == [(2, "first", "one", "1")]


def test_patches_of_a_file_with_many_credentials(spark):
    """The answer's third patch names no finding, however many a file has."""
    keys = "\n".join(f'api_key = "abcdefgh{i:04d}xyz"' for i in range(12))
    made = catalog._patches_of(files_of(spark, [("r", "a.txt", keys), ("r", "b.txt", keys[:30])])).collect()
    assert sorted((p["path"], p["seq"], p["finding"]) for p in made) == [
        ("a.txt", 0, "Hardcoded secret/credential"), ("a.txt", 2, "Fix"), ("b.txt", 0, "Hardcoded secret/credential"), ("b.txt", 2, "Fix")]


def test_titles_are_worked_out_once(spark):
    """Which files were asked about and the titles come from one pass over the findings."""
    found = spark.createDataFrame([finding("r", "Clarity", "high", "a.py", sub=i, title=f"t{i}") for i in range(3)], FINDINGS_SCHEMA)
    reply = json.dumps([{"finding_index": i, "original": "one", "fixed": "1"} for i in (2, 0, 4, 3)])
    answered = spark.createDataFrame([("r", "a.py", reply), ("r", "b.py", reply)], "repo string, key string, text string")
    made = patches.proposed(found, files_of(spark, [("r", "a.py", "one two"), ("r", "b.py", "one")]), answered)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    assert sorted((p["path"], p["seq"], p["finding"]) for p in made.collect()) == [("a.py", 0, "t1"), ("a.py", 1, "Fix"), ("a.py", 2, "Fix"), ("a.py", 3, "t2")]


@pytest.mark.parametrize("reply, want", [
    ("[]", []), ("[1]", [None]), ("[1] and more", None), ("{}", None), (None, None), ('```json\n[{"index": 4}]\n```', [4]),
    ('[{"index": 99999999999}, {"index": 2}]', [None, 2]), ('[{"index": 1, "index": 2}]', None)])
def test_parsed_forms(spark, reply, want):
    rows = spark.createDataFrame([(reply,)], "text string").select(answers.parsed(F.col("text"), answers.VERDICTS)["index"].alias("i"))
    assert rows.first()["i"] == want


def test_budget_over_many_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), f"p{i:05d}", rng.choice([0, 0, 1, 7, 400])) for i in range(4000)]
    rows += [("zero", f"z{i}", 0) for i in range(50)] + [("one", "huge", 10**9), ("one", "later", 1)]
    df = spark.createDataFrame(rows, "g string, k string, n long")
    got = {(r["k"], r["before"]) for r in within_budget(df, ["g"], ["k"], "n", "before", 5000, 23).collect()}
    want, total = set(), {}
    for g, k, n in sorted((g or "", k, n) for g, k, n in rows):
        if total.get(g, 0) <= 5000:
            want.add((k, total.get(g, 0)))
        total[g] = total.get(g, 0) + n
    assert got == want
    assert within_budget(df.limit(0), ["g"], ["k"], "n", "before", 5000).count() == 0


def test_one_repo_uses_many_tasks(spark):
    rows = spark.range(20000).select(F.lit("r").alias("g"), F.format_string("p%06d", "id").alias("k"), F.lit(1).alias("n"))
    dealt = _ranged(rows, ["g"], ["k"], 16).groupBy("_part").count().collect()
    assert len(dealt) >= 12 and max(r["count"] for r in dealt) < 4000
