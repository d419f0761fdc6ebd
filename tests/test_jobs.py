"""Vectors and edge cases for scoring, history, answers, patches, prompts, reports and ingest."""

from __future__ import annotations

import json
import os
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from lintlake import sinks
from lintlake.functions.ranking import numbered
from lintlake.operators import answers, cost, patches, projects, prompts, report, scoring, testgen, trends
from lintlake.operators.findings import FINDINGS_SCHEMA
from lintlake.plans.checks import all_findings, all_notes, register_check, unregister_check
from lintlake.sources import history, overrides
from lintlake.sources.files import FILES_SCHEMA, collected, read_directories


def files_of(spark, rows):
    return spark.createDataFrame([(r, p, c, len(c.encode())) for r, p, c in rows], FILES_SCHEMA)


def finding(repo, analyzer, severity, file="a.py", line=1, sub=0, title="t", category="clarity"):
    return (repo, analyzer, category, "X", file, severity, title, "d", "s", line, None, None,
            (0, 0, file, 0, sub))


# --- scores --------------------------------------------------------------------------------------


def test_scores(spark):
    rows = (
        [finding("a", "Clarity", "high")] + [finding("a", "Functionality", "critical")]
        + [finding("a", "Security", "critical")] * 5 + [finding("a", "Automation", "low")]
        + [finding("a", "Structure", "weird")] + [finding("a", "AST Analysis", "critical")] * 9
    )
    found = spark.createDataFrame(rows, FINDINGS_SCHEMA)
    repos = spark.createDataFrame([("a", 1), ("clean", 9)], "repo string, n_files long")
    by = {(r["repo"], r["analyzer"]): r["score"] for r in scoring.analyzer_scores(found, repos).collect()}
    assert by["a", "Clarity"] == 8 and by["a", "Functionality"] == 7 and by["a", "Security"] == 1
    assert by["a", "Structure"] == D("9.5") and by["a", "Automation"] == D("9.7") and by["a", "Reusability"] == 10
    assert len(by) == 14 and all(v == 10 for (r, _), v in by.items() if r == "clean")
    a = scoring.repo_scores(found, repos).filter("repo = 'a'").first()
    # quality 7.5; structure 9.75 -> 9.8; usefulness (9.7 + 7.5) / 2; overall without the syntax analyzer
    assert (a["quality"], a["structure"], a["security"], a["usefulness"]) == (D("7.5"), D("9.8"), D("1.0"), D("8.6"))
    assert a["overall"] == D("6.7")


@pytest.mark.parametrize("overall, n, want", [
    (7.5, 4, "promote"), (7.5, 3, "maintain"), (7.4, 9, "maintain"), (4.5, 9, "maintain"), (4.4, 9, "maintain"),
    (2.5, 9, "maintain"), (2.4, 9, "archive"), (2.4, 2, "maintain"), (1.0, 3, "archive")])
def test_recommendation(spark, overall, n, want):
    row = spark.range(1).select(scoring.recommendation(F.lit(D(str(overall))), F.lit(n)).alias("r")).first()
    assert row["r"] == want


@pytest.mark.parametrize("texts, repo, want", [
    (["Customer INVOICE"], "x", "biz"), (["docker deploy"], "x", "ops"), ([""], "x", "util"),
    (["user docker"], "x", "biz"), (["zzz"], "sandbox-demo", "lab"), (["user"], "docker-deploy", "ops"),
    (["pay", "ment"], "x", "util")])
def test_tags(spark, texts, repo, want):
    files = files_of(spark, [(repo, f"f{i}", t) for i, t in enumerate(texts)])
    assert scoring.tags(files).first()["tag"] == want


@pytest.mark.parametrize("chars, mode, tokens, out, usd", [
    (4000, "smart", 250, 2000, "0.0308"), (4000, "auto-fix", 1000, 500, "0.0105"), (0, "smart", 0, 2000, "0.0300"),
    (11100, "smart", 693, 2000, "0.0321"), (3, "auto-fix", 0, 0, "0.0000")])
def test_cost(spark, chars, mode, tokens, out, usd):
    row = cost.estimate_cost(files_of(spark, [("r", "f", "x" * chars)]), mode).first()
    assert (row["input_tokens"], row["output_tokens"], row["estimated_cost_usd"]) == (tokens, out, D(usd))
    with pytest.raises(ValueError):
        cost.estimate_cost(files_of(spark, [("r", "f", "x")]), "other")


def test_top_findings_are_stable(spark):
    order = ["low", "critical", "weird", "high", "critical", "medium", "low"]
    rows = [finding("a", "Clarity", s, sub=i, title=f"t{i}") for i, s in enumerate(order)]
    random.Random(1).shuffle(rows)
    top = scoring.top_findings(spark.createDataFrame(rows, FINDINGS_SCHEMA)).orderBy("rank").collect()
    assert [r["title"] for r in top] == ["t1", "t4", "t3", "t5", "t0"]


# --- history -------------------------------------------------------------------------------------


def test_history_documents(spark):
    run = {"timestamp": "2024-01-02T03:04:05", "scores": {"quality": 7.5}, "findings_count": 3,
           "files_analyzed": 2, "mode": "static"}
    docs = [("a", json.dumps({"runs": [run, run]})), ("b", "{oops"), ("c", "{}"), ("d", '{"runs": null}'),
            ("e", ""), ("f", '{"runs": []}')]
    rows = history.parse_history(spark.createDataFrame(docs, "repo string, document string")).collect()
    assert [r["repo"] for r in rows] == ["a", "a"]
    assert rows[0]["quality"] == D("7.5") and rows[0]["overall"] is None and rows[1]["run_id"] == 1


def test_previous_run_over_bucket_borders(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "b"]), f"2024-01-{rng.randrange(1, 28):02d} {rng.randrange(24):02d}:00:00", i,
             *[D(rng.randrange(10, 100)) / 10] * 5, 0, 0, "static") for i in range(300)]
    schema = ("repo string, ts string, run_id long, quality decimal(4,1), structure decimal(4,1), security decimal(4,1), "
              "usefulness decimal(4,1), overall decimal(4,1), findings_count long, files_analyzed long, mode string")
    runs = spark.createDataFrame(rows, schema).withColumn("run_ts", F.to_timestamp("ts")).drop("ts")
    got = {r["run_id"]: r["prev"] and r["prev"]["overall"] for r in trends.with_previous(runs).collect()}
    want = {}
    for repo in ("hot", "b"):
        mine = sorted((r for r in rows if r[0] == repo), key=lambda r: (r[1], r[2]))
        want.update({b[2]: a[7] for a, b in zip(mine, mine[1:])})
        want[mine[0][2]] = None
    assert got == want
    one = trends.trend_section(runs.filter("run_id = 0")).collect()
    assert one[-1]["line"].startswith("First run")


# --- answers and patches ---------------------------------------------------------------------------


def test_verdicts(spark):
    found = spark.createDataFrame(
        [finding("r", "Clarity", "low", f, sub=i, title=f"{f}{i}") for f in "abcdefg" for i in range(2)]
        + [finding("r", "Clarity", "low", "a, b", sub=2, title="multi")], FINDINGS_SCHEMA)
    files = files_of(spark, [("r", f, "" if f == "g" else "text") for f in "abcdefg"])
    replies = [
        ("r", "a", '[{"index":1,"valid":true,"reason":"yes","improved_suggestion":"better"},{"index":3,"valid":true}]'),
        ("r", "b", '```json\n[{"index":1,"valid":false},{"index":2}]\n```'),
        ("r", "c", "sorry"), ("r", "d", '[{"index":99,"valid":true},{"index":0}]'), ("r", "e", "[]"),
        ("r", "g", '[{"index":1,"valid":false}]'),
    ]
    responses = spark.createDataFrame(replies, "repo string, key string, text string")
    kept = {r["title"]: (r["suggestion"], r["description"]) for r in answers.validated(found, files, responses).collect()}
    assert kept == {
        "a0": ("better", "d [AI: yes]"), "multi": ("s", "d [AI: ]"), "b1": ("s", "d [AI: ]"),
        "c0": ("s", "d"), "c1": ("s", "d"), "f0": ("s", "d"), "f1": ("s", "d"), "g0": ("s", "d"), "g1": ("s", "d"),
    }


@pytest.mark.parametrize("reply, want", [
    ("  plain ", "plain"), ("```json\n[1]\n```", "[1]\n"), ("```\na\n```\nb\n``` tail", "a\n```\nb\n"),
    ("```x", None), ("```\nopen", "open"), ("a ```b```", "a ```b```")])
def test_unfenced(spark, reply, want):
    assert spark.range(1).select(answers.unfenced(F.lit(reply)).alias("x")).first()["x"] == want


def test_review_defaults(spark):
    text = '[{"title":"T"},{"file":"f","severity":"high","line":3}]'
    rows = spark.createDataFrame([("r", text), ("s", "no")], "repo string, text string")
    got = [(r["file"], r["severity"], r["title"], r["line"], r["category"])
           for r in answers.review_findings(rows).orderBy("ord").collect()]
    assert got == [("(unknown)", "medium", "T", None, "ai_review"), ("f", "high", "AI Finding", 3, "ai_review")]


def test_patches_apply_in_sequence(spark):
    files = files_of(spark, [("r", "a.py", "one two two three"), ("r", "b.py", "keep")])
    rows = [("r", "a.py", i, "t", o, n, "") for i, (o, n) in enumerate(
        [("one", "two"), ("three", "four"), ("four", "4"), ("two", "x"), ("missing", "y")])]
    schema = "repo string, path string, seq int, finding string, original string, fixed string, explanation string"
    proposed = spark.createDataFrame(rows, schema)
    dry = patches.apply_patches(proposed, files)
    assert sorted(r["original"] for r in dry.collect()) == ["one", "three"]
    done = patches.apply_patches(proposed, files, dry_run=False)
    assert sorted(r["original"] for r in done.collect()) == ["four", "one", "three"]
    after = {r["path"]: r["content"] for r in patches.patched_files(proposed, files).collect()}
    assert after == {"a.py": "two two two 4", "b.py": "keep"}
    lines = [r["line"] for r in patches.patch_lines(dry).orderBy("number", "line_no").collect()]
    assert lines[0] == "### Patch 1: t" and "- one" in lines and "+ two" in lines and "### Patch 2: t" in lines
    assert "**File:** `a.py` | **Status:** ready" in lines


def test_row_numbers_of_a_large_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("g"),
                                  F.xxhash64("id").alias("k"))
    got = numbered(df, ["g"], ["k"], "n").collect()
    for g in "ab":
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["k"])
        assert [r["n"] for r in mine] == list(range(1, len(mine) + 1))


def test_review_budget_is_exact(spark):
    rng = random.Random(5)
    rows = [("r", f"p{i:04d}.py", "x" * rng.choice([0, 10, 5999, 6000, 6001, 20000])) for i in range(400)]
    rows += [("r", "a.json", "x" * 90000), ("s", "one.py", "y" * 3)]
    got = {(r["repo"], r["path"]): r["included"] for r in prompts.review_budget(files_of(spark, rows), salts=7).collect()}
    want, total = {("s", "one.py"): True}, 0
    for repo, path, content in sorted(rows):
        if repo == "r" and not path.endswith(".json"):
            n = len(content)
            total += n if n <= 6000 else 6000 + len(f"\n# ... [{n - 6000} more chars, file continues] ...")
            want[repo, path] = total <= 80000
            if total > 80000:
                break
    assert got == want


def test_generated_tests(spark):
    rows = [("r", "a/m.py", "def test_1(): 0\ndef test_2(): 0"), ("r", "b/m.py", "```\nx\nasync def test_3(): 0\n```"),
            ("r", "c.tar.py", "```"), ("r", "d.py", "\ndef test_a(): 0\n")]
    made = testgen.answered_tests(spark.createDataFrame(rows, "repo string, path string, text string"))
    kept = {r["test_path"]: (r["source_path"], r["num_tests"]) for r in testgen.generated_tests(made).collect()}
    # Stripping removes the leading line end, so d.py's only test is on the first line.
    assert kept == {"tests/test_m.py": ("b/m.py", 1), "tests/test_d.py": ("d.py", 0)}
    total = testgen.test_totals(made).first()
    assert (total["tests_generated"], total["n_files"]) == (2, 2)


# --- report ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("rows, want", [
    ([("README.md", "# Title\n\nbody")], "Title"),
    ([("README.md", "![b](x)\n\n<!-- c -->\n\n## Real ##\nmore")], "Real ##\nmore"),
    ([("README.md", "![only](x)"), ("README.txt", "text one")], "text one"),
    ([("readme.md", "lower"), ("README.rst", "rst")], "lower"),
    ([("b.py", '"""B."""'), ("a.py", '"""open')], "B."),
    ([("a.py", 'x = """no"""')], report.fv.NO_DESCRIPTION),
    ([("README.md", "y" * 400)], "y" * 300)])
def test_descriptions(spark, rows, want):
    files = files_of(spark, [("r", p, c) for p, c in rows])
    assert report.describe(files).first()["description"] == want


def test_report_text(spark, tmp_path):
    files = files_of(spark, [("bad", "a.py", "# TODO x\nimport os\n"), ("bad", ".gitignore", "venv/"), ("ok", "pyproject.toml", "[x]"),
                             ("ok", ".github/workflows/ci.yml", "on"), ("ok", ".gitignore", "\n".join(report.fv.IGNORE_ENTRIES))])
    found = all_findings(files).checkpoint()
    cards = scoring.scorecard(found, files).checkpoint()
    runs = history.new_run(cards, F.lit("2024-01-01").cast("timestamp"), F.lit(1))
    trend = trends.trend_section(runs).select("repo", F.lit(0).alias("block"), F.lit("").alias("name"), "line_no", "line")
    lines = report.report_lines(found, cards, report.describe(files), all_notes(files), "now", extra={report.TREND: trend})
    text = {}
    for r in report.in_order(lines).collect():
        text.setdefault(r["repo"], []).append(r["line"])
    ok, bad = "\n".join(text["ok"]), "\n".join(text["bad"])
    assert ok.startswith("# Quality Report: ok\n\n**Generated:** now\n**Version:** 1.0.0\n\n## Summary\n\n**What")
    assert "## Top 5 Improvements\n\nNo significant issues found.\n\n## File-by-File Analysis\n\nAll files look clean.\n\n## Next" in ok
    assert "### Priority 3: Add Automation\n- [ ] Add CI/CD pipeline\n- [ ] Add pre-commit hooks\n\n### Automatable" in ok
    assert "dependabot/renovate\n\n\n## Trend Tracking\n\nFirst run" in ok and "comparisons.\n\n---\n\n*Generated by" in ok
    assert "**Tag:** `" in bad and "### Additional Notes\n\n- [Security] .gitignore could also cover: .env, __pycache__, *.pyc, node_modules/\n" in bad
    assert "### `a.py`\n*3 finding(s)*\n\n" in bad
    assert bad.index("### 1. 🟠 [HIGH] No tests found\n**File:** `(repo root)`\n\n1 code files but no test files.\n\n**Suggestion:** ") > 0
    sinks.write_report(lines, str(tmp_path / "reports"))
    for repo, want in (("ok", ok), ("bad", bad)):
        sinks.export_report(spark, str(tmp_path / "reports"), repo, str(tmp_path / repo))
        parts = sorted((tmp_path / repo).glob("part-*"))
        assert "".join(p.read_text() for p in parts) == want + "\n"


# --- projects, overrides, sources --------------------------------------------------------------------


@pytest.mark.parametrize("names, kind, status", [
    (["next.config.ts", "package.json"], "nextjs", "ready"), (["vite.config.js"], "vite-react", "ready"),
    (["package.json", "apps/x.js"], "node-monorepo", "not_launchable"), (["package.json"], "unknown", "not_scanned"),
    (["setup.py"], "python-package", "not_launchable"), (["a.py"], "python-script", "not_launchable"),
    (["Dockerfile"], "docker", "ready"), (["index.html"], "static-site", "ready"),
    (["x.ps1"], "powershell-scripts", "not_launchable"), (["src/a.py"], "unknown", "not_scanned")])
def test_project_types(spark, names, kind, status):
    row = projects.detect_projects(files_of(spark, [("r", n, "") for n in names])).first()
    assert (row["project_type"], row["status"]) == (kind, status)


def test_project_probe(spark):
    files = files_of(spark, [("a", "m.py", "from fastapi import X"), ("b", "src/m.py", "import flask"), ("b", "z.py", ""),
                             ("c", "m.py", "import flask"), ("d", "app.py", ""), ("d", "requirements.txt", "streamlit"),
                             ("e", "m.py", "import flask" + " " * 100_000)])
    kinds = {r["repo"]: (r["project_type"], r["needs_install"]) for r in projects.detect_projects(files).collect()}
    assert kinds == {"a": ("fastapi", True), "b": ("python-script", False), "c": ("flask", True), "d": ("streamlit", True),
                     "e": ("python-script", False)}


def test_overrides_do_not_mix(spark):
    schema = "repo string, section string, key string, value string"
    first = spark.createDataFrame([("a", "clarity", "x", "1")], schema)
    second = spark.createDataFrame([("a", "clarity", "y", "2"), ("b", "clarity", "y", "3")], schema)
    repos = spark.createDataFrame([("a",), ("b",), ("c",)], "repo string")
    chosen = overrides.effective_overrides(repos, [first, second])
    got = overrides.option_values(repos, chosen, {("clarity", "x"): "dx", ("clarity", "y"): "dy"}).collect()
    assert {(r[0], r[1], r[2]) for r in got} == {("a", "1", "dy"), ("b", "dx", "3"), ("c", "dx", "dy")}


def test_directory_ingest(spark, tmp_path):
    tree = {
        "main.py": b"a\r\nb\rc", ".gitignore": b"x", ".hidden": b"h", "__init__.py": b"", "README.MD": b"r",
        "sub/m.py": b"\xff\xc3(ok", "node_modules/p.js": b"n", "sub/dist/q.py": b"q", "sub/distance/q.py": b"q",
        "big.py": b"x" * 500_001, "edge.py": b"x" * 500_000, "image.png": b"p", "Makefile": b"m",
    }
    for name, data in tree.items():
        full = tmp_path / name
        os.makedirs(full.parent, exist_ok=True)
        full.write_bytes(data)
    roots = spark.createDataFrame([("r", str(tmp_path))], "repo string, root string")
    rows = {r["path"]: r for r in collected(read_directories(spark, roots)).collect()}
    assert set(rows) == {"main.py", ".gitignore", ".hidden", "__init__.py", "README.MD", "sub/m.py", "sub/distance/q.py",
                         "edge.py"}
    assert rows["main.py"]["content"] == "a\nb\nc" and rows["main.py"]["size"] == 6
    assert rows["sub/m.py"]["content"] == b"\xff\xc3(ok".decode("utf-8", "replace")


def test_custom_check(spark):
    files = files_of(spark, [("r", "a.py", "x")])
    order = "named_struct('analyzer', 9, 'phase', 0, 'path', path, 'check', 0, 'sub', 0) ord"
    rule = lambda f: f.selectExpr(
        "repo", "'Custom' analyzer", "'custom' category", "'CUS1' check_id", "path file", "'low' severity", "'T' title",
        "'D' description", "'S' suggestion", "1 line", "null code_before", "null code_after", order)
    register_check("CUS1", "Custom", "file", rule)
    try:
        assert all_findings(files).filter("check_id = 'CUS1'").count() == 1
        register_check("CUS1", "Custom", "file", lambda f: f.select("repo"))
        with pytest.raises(ValueError):
            all_findings(files)
    finally:
        unregister_check("CUS1")


def test_sinks(spark, tmp_path):
    cards = spark.createDataFrame([("a", D("5.0"), "biz", "maintain", 3), ("b", D("9.1"), "ops", "promote", 1)],
                                  "repo string, overall decimal(4,1), tag string, recommendation string, total long")
    sinks.write_portfolio(scoring.portfolio(cards), str(tmp_path / "p"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "p").glob("part-*")))
    body = [line for line in text.splitlines() if not line.startswith("Repo,")]
    assert body == ["b,9.1,ops,promote,1", "a,5.0,biz,maintain,3"]


def test_writers_round_trip(spark, tmp_path):
    from lintlake.operators.report import ORDER

    order = {c: i for i, c in enumerate(ORDER)}
    rows = [("b", "two"), ("a", "one"), ("a", "three")]
    columns = [F.col("repo") if c == "repo" else F.lit(order[c]).alias(c) for c in ORDER]
    lines = spark.createDataFrame(rows, "repo string, line string").select(*columns, "line")
    sinks.write_report(lines, str(tmp_path / "report"))
    assert sorted((r.repo, r.line) for r in spark.read.parquet(str(tmp_path / "report")).collect()) == sorted(rows)
    assert not list((tmp_path / "report").glob("repo=*"))
    sinks.export_report(spark, str(tmp_path / "report"), "b", str(tmp_path / "one"))
    assert [r.value for r in spark.read.text(str(tmp_path / "one")).collect()] == ["two"]

    cards = spark.createDataFrame(
        [("a", D("5.0"), D("1.0"), D("2.0"), D("3.0"), D("4.0"), 7, 3)],
        "repo string, quality decimal(4,1), structure decimal(4,1), security decimal(4,1), usefulness decimal(4,1), "
        "overall decimal(4,1), total long, n_files long",
    )
    runs = history.new_run(cards, F.lit("2024-01-02 03:04:05").cast("timestamp"), F.lit(1).cast("long"))
    for _ in range(2):  # a retry
        sinks.append_run(runs, str(tmp_path / "runs"), "b1")
        sinks.write_history(runs, str(tmp_path / "documents"), "b1")
    sinks.append_run(runs, str(tmp_path / "runs"), "b2")
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2
    document = spark.read.parquet(str(tmp_path / "documents")).first().document
    whole = '{"runs": [' + document + "]}"
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.json").write_text(whole)
    back = history.read_history(spark, str(tmp_path / "h"), F.regexp_extract("file", r"([^/]+)\.json$", 1))
    shared = [c for c in back.columns if c != "run_id"]
    assert back.select(*shared).collect() == runs.select(*shared).collect()

    files = files_of(spark, [("r", "a.py", "x = 1")])
    sinks.write_files(files, str(tmp_path / "files"))
    assert spark.read.parquet(str(tmp_path / "files")).collect() == files.collect()
    meta = spark.createDataFrame([("a", 1)], "repo_path string, files_analyzed int")
    sinks.write_metadata(meta, str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).first().repo_path == "a"
    sinks.write_session(meta, meta.select(F.count("*").alias("total")), "t0", str(tmp_path / "session"))
    assert spark.read.json(str(tmp_path / "session" / "summary")).first().total == 1


def test_streaming_files(spark, tmp_path):
    from lintlake.operators.findings import file_findings
    from lintlake.plans.checks import FILE_CHECKS
    from lintlake.streaming import append_file_findings

    files = files_of(spark, [("r", "a.py", "eval(x)"), ("r", "b.py", "# TODO")])
    files.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FILES_SCHEMA).parquet(str(tmp_path / "in"))
    append_file_findings(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("file", "title").collect()
    assert sorted(got) == sorted(file_findings(files, FILE_CHECKS).select("file", "title").collect())
