"""Folder source, refused files, literals of patterns, reviewed runs that go on, blocks of several widths."""

from __future__ import annotations

import json
import os
import random
import re
import sys
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions.prefilter import may_match, required_literals
from lintlake.operators import pyfacts, reusability, scoring
from lintlake.operators.findings import file_findings
from lintlake.operators.security import FILE_CHECKS
from lintlake.options import Options
from lintlake.plans import smart
from lintlake.sources import fixtures, folder, overrides
from tests.test_jobs import files_of

SMALL = "/root/testdata/sf0.001"


# --- folder source -------------------------------------------------------------------------------


def make_tree(root, files):
    for name, data in files.items():
        full = root / name
        os.makedirs(full.parent, exist_ok=True)
        full.write_bytes(data)


TREE = {
    "a.py": b"x\r\ny", "deep/b/c/d.py": b"1", "deep/b/e.md": b"\xff\xfe", "deep/big.py": b"z" * 500_001, "node_modules/n.py": b"n",
    "wide/w1/a.py": b"", "wide/w2/a.py": b"22", "wide/w3/.env": b"K=1", "wide/w3/pic.png": b"p",
}


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_folder_source(spark, tmp_path, parts):
    make_tree(tmp_path / "r", TREE)
    os.symlink(tmp_path / "nowhere", tmp_path / "r" / "link.py")
    roots = {"r": str(tmp_path / "r"), "gone": str(tmp_path / "no_such_folder")}
    counts = folder.ingest(spark, roots, str(tmp_path / "rows"), parts=parts)
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert counts == {"seen": rows.count(), "too_large": 1, "unreadable": 2, "bad_bytes": 1}
    refused = {(r.repo, r.path): (r.size, r.error) for r in folder.refused(rows).collect()}
    assert refused.pop(("r", "deep/big.py")) == (500_001, folder.TOO_LARGE) and refused.pop(("r", "link.py")) == (None, folder.UNREADABLE)
    assert refused.pop(("r", "deep/b/e.md")) == (2, folder.BAD_BYTES) and [k[0] for k in refused] == ["gone"]
    taken = {r.path: r.content for r in folder.taken(rows).collect()}
    assert taken == {"a.py": "x\ny", "deep/b/c/d.py": "1", "deep/b/e.md": "\ufffd\ufffd", "wide/w1/a.py": "", "wide/w2/a.py": "22", "wide/w3/.env": "K=1"}


def test_folder_planning(tmp_path):
    """Folders cover each file once, and one root alone is several partitions."""
    make_tree(tmp_path, TREE)
    for parts in (1, 2, 5, 100):
        found = folder.planned({"r": str(tmp_path)}, parts)
        read = folder._Rows({"roots": "{}"})
        paths = Counter(os.path.relpath(full, tmp_path) for f in found for full, _ in read.walk(f))
        assert paths == Counter(n for n in TREE if not n.startswith("node_modules"))
        assert parts == 1 or len(found) >= min(parts, 4)


def test_folder_filters_are_pushed(spark, tmp_path):
    """Filters on size and path reach the source, so the files that they refuse are not opened."""
    make_tree(tmp_path / "r", TREE)
    roots = {"r": str(tmp_path / "r")}
    rows = folder.folder_rows(spark, roots).filter((F.col("size") <= 2) & F.col("path").startswith("wide/"))
    assert {r.path for r in rows.collect()} == {"wide/w1/a.py", "wide/w2/a.py", "wide/w3/pic.png"}
    reader = folder._Reader({"roots": "{}"})
    left = list(reader.pushFilters([folder.LessThanOrEqual(("size",), 2), folder.StringStartsWith(("path",), "w"), folder.EqualTo(("repo",), "r")]))
    assert left == [folder.EqualTo(("repo",), "r")] and len(reader.taken) == 2
    assert reader.wanted("wide", 2) and not reader.wanted("deep", 2) and not reader.wanted("wide", 3) and not reader.wanted("wide", None)


def test_folder_stream(spark, tmp_path):
    """Each run of a stream reads the files that came after the one before."""
    root = tmp_path / "r"

    def run():
        rows = folder.checked(folder.folder_stream(spark, {"r": str(root)}))
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return Counter(r.path for r in spark.read.parquet(str(tmp_path / "out")).collect())

    make_tree(root, {"a.py": b"1", "s/b.py": b"2"})
    assert run() == Counter(["a.py", "s/b.py"])
    make_tree(root, {"s/c.py": b"3"})
    assert run() == Counter(["a.py", "s/b.py", "s/c.py"])
    assert run() == Counter(["a.py", "s/b.py", "s/c.py"])


# --- literals of patterns ------------------------------------------------------------------------

PATTERNS = [p for p, _ in [*fv.SECRET_PATTERNS, *fv.UNSAFE_PATTERNS]]


def test_literals_of_the_rules():
    assert required_literals(PATTERNS[2]) == (["sk-"], False)
    assert required_literals(PATTERNS[4]) == (["mongodb"], True)
    assert all(required_literals(p) for p in PATTERNS)
    assert required_literals("a?b*") is None and required_literals("(x|y*)") is None and required_literals("(ab|c)+") == (["ab", "c"], False)


PIECES = ["api", "_", "-", "key", "KEY", "toKen", "paſſword", "apİ", "=", " ", "'", '"', "abcdefgh", "sk-", "a" * 20, "ghp_", "b" * 36, "mongodb",
          "+srv", "://", "u:p@", "mysql", "postgres", "eval", "(", "subprocess.", "shell", "True", "os.system", "pickle.load", "yaml.load", ")", "\n"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=9))
def test_literals_are_there_where_a_pattern_matches(parts):
    whole = "".join(parts)
    for p in PATTERNS:
        literals, ignore = required_literals(p)
        if re.search(p, whole):
            odd = ignore and any(c in whole for c in "İıſ")
            assert odd or any(x in (whole.lower() if ignore else whole) for x in literals)


def test_gated_checks_find_the_same(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["paſſword = 'abcdefghi'", "apİ_key='12345678'"]
    files = files_of(spark, [("r", f"{i}.py", t) for i, t in enumerate(texts)])
    found = file_findings(files, FILE_CHECKS).groupBy("file", "title").count().collect()
    assert {r.file for r in found} >= {"3000.py"}
    gate = files.select("path", *[may_match(F.col("content"), p).alias(f"m{k}") for k, p in enumerate(PATTERNS)]).collect()
    closed = {(r.path, k) for r in gate for k in range(len(PATTERNS)) if not r[f"m{k}"]}
    assert len(closed) > 1000 and not any(re.search(PATTERNS[k], texts[int(path.split(".")[0])]) for path, k in closed)


# --- reviewed run --------------------------------------------------------------------------------


def test_smart_run_goes_on(spark, tmp_path):
    """A second run makes nothing; one that lost a table makes that one alone; counts add up."""
    code = fixtures.code_files(spark, SMALL)
    run = lambda: smart.smart_run(code, fixtures.verdict_answers, fixtures.review_answers(code), str(tmp_path / "run"))
    made = []
    table = smart.Stages.table

    def counted(self, name, make):
        before = len(self.made)
        out = table(self, name, make)
        made.extend(self.made[before:])
        return out

    smart.Stages.table = counted
    try:
        first = run()
        assert made == ["facts", "findings", "notes", "validated", "review", "cards"]
        card = first.cards.collect()
        made.clear()
        assert Counter(run().cards.collect()) == Counter(card) and made == []
        os.rename(tmp_path / "run" / "validated", tmp_path / "lost")
        first = run()
        assert Counter(first.cards.collect()) == Counter(card) and made == ["validated"]
    finally:
        smart.Stages.table = table
    assert all(r.total == r.n_before - r.n_dismissed + r.n_added for r in card) and any(r.n_dismissed for r in card)
    assert any(r.ai_score is not None for r in card) and any(r.ai_score is None for r in card)
    lines = smart.smart_report(first, code, "now").filter("repo = 'src0'")
    assert lines.count() > 20
    assert scoring.top_findings(first.kept).groupBy("repo").count().filter("count > 5").isEmpty()


def test_smart_tables_by_need(spark, tmp_path):
    """A table of a reviewed run is made when it is first read, and is that of the whole run."""
    code = fixtures.code_files(spark, SMALL)
    run = lambda of, name: of(code, fixtures.verdict_answers, fixtures.review_answers(code), str(tmp_path / name))
    whole = run(smart.smart_run, "whole")
    for name, made in (("review", {"review"}), ("validated", {"facts", "findings", "validated"}),
                       ("cards", {"facts", "findings", "validated", "review", "cards"})):
        assert Counter(getattr(run(smart.SmartRun, name), name).collect()) == Counter(getattr(whole, name).collect())
        assert set(os.listdir(tmp_path / name)) == made


def test_review_scores(spark):
    rows = [("a", s) for s in ("critical", "high", "odd")] + [("b", "critical")] * 4 + [("c", "low")]
    got = {r.repo: float(r.score) for r in smart.review_scores(spark.createDataFrame(rows, "repo string, severity string")).collect()}
    assert got == {"a": 4.5, "b": 1.0, "c": 9.7}


def test_patches_of_a_reviewed_run(spark, tmp_path):
    """Only findings that are kept are patched; the section names every repo; applied patches make a new table."""
    key = 'api_key = "abcdefghijklmnop1234"'
    files = files_of(spark, [("r", "a.py", f"{key}\nx = 1\n"), ("r", "b.py", f"{key}\n"), ("s", "c.py", "x = 1\n")])

    def verdicts(found):  # everything in b.py is a false alarm
        n = found.filter("file = 'b.py'").groupBy("repo", F.col("file").alias("key")).agg(F.count(F.lit(1)).alias("n"))
        entry = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.struct(i.alias("index"), F.lit(False).alias("valid")))
        return n.select("repo", "key", F.to_json(entry).alias("text"))

    reviews = spark.createDataFrame([], "repo string, text string")
    place = str(tmp_path / "run")
    run = smart.smart_run(files, verdicts, reviews, place, known_facts=str(tmp_path / "facts"))
    fix = json.dumps([{"finding_index": 1, "original": key, "fixed": "api_key = read()", "explanation": "why"}])
    fixes = lambda wanted: wanted.select("repo", F.col("file").alias("key")).distinct().withColumn("text", F.lit(fix))
    for apply, label in ((False, "ready"), (True, "done")):
        done, section = smart.smart_patches(run, files, fixes, place, apply)
        assert [(r.repo, r.path) for r in done.collect()] == [("r", "a.py")]
        lines = {repo: [r.line for r in section.filter(F.col("repo") == repo).orderBy("block", "line_no").collect()] for repo in "rs"}
        assert lines["s"] == ["## Auto-Fix Patches", "", "No patches generated."]
        assert lines["r"][:4] == ["## Auto-Fix Patches", "", "**1 patches generated**", ""]
        assert lines["r"][5:] == [f"**File:** `a.py` | **Status:** {label}", "", "why", "", "```diff", f"- {key}", "+ api_key = read()", "```", ""]
    patched = {r.path: r.content for r in spark.read.parquet(f"{place}/patched").collect()}
    assert patched == {"a.py": "api_key = read()\nx = 1\n", "b.py": f"{key}\n", "c.py": "x = 1\n"}
    text = [r.line for r in smart.report.in_order(smart.smart_report(run, files, "now", {smart.report.PATCHES: section})).filter("repo = 'r'").collect()]
    at = text.index("## Auto-Fix Patches")
    assert text[at - 2 : at] == ["", ""] and text[at + len(lines["r"]) :][:2] == ["", "---"]


# --- blocks of several widths --------------------------------------------------------------------


def plain_blocks(rows, width, least):
    files = defaultdict(dict)
    for repo, path, content in rows:
        code = [x.strip() for x in content.split("\n")]
        code = [x for x in code if x and not x.startswith("#")]
        for i in range(len(code) - width[repo] + 1):
            block = "\n".join(code[i : i + width[repo]])
            if len(block) >= least[repo]:
                files[repo, block].setdefault(path, i + 1)
    return Counter((r, b, len(f), min(f), f[min(f)]) for (r, b), f in files.items() if len(f) > 1), Counter(
        (r, p, i, b, len(f)) for (r, b), f in files.items() if len(f) > 1 for p, i in f.items())


@pytest.mark.parametrize("split", [1000, 2])
def test_blocks_of_several_widths(spark, monkeypatch, split):
    monkeypatch.setattr(reusability, "SPLIT", split)
    rng = random.Random(4)
    lines = ["alpha = 1", "  beta = 22", "# note", "", "gamma = call(3)", "delta", "x"]
    rows = [(f"r{k % 3}", f"f{k:02d}.py", "\n".join(rng.choice(lines) for _ in range(rng.randrange(25)))) for k in range(36)]
    width, least = {"r0": 2, "r1": 3, "r2": 5}, {"r0": 12, "r1": 30, "r2": 1}
    files = files_of(spark, rows).withColumn("opt_block_size", F.expr("case repo when 'r0' then 2 when 'r1' then 3 else 5 end"))
    files = files.withColumn("opt_min_block_length", F.expr("case repo when 'r0' then 12 when 'r1' then 30 else 1 end"))
    options = Options(block_size=F.col("opt_block_size"), min_block_length=F.col("opt_min_block_length"))
    blocks, members = plain_blocks(rows, width, least)
    got = reusability.duplicate_blocks(files, options).collect()
    assert Counter((r.repo, r.block, r.n_files, r.first_file, r.first_idx) for r in got) == blocks and blocks
    got = reusability.block_files(files, options).collect()
    assert Counter((r.repo, r.path, r.idx, r.block, r.n_files) for r in got) == members
    plain, _ = plain_blocks(rows, dict.fromkeys(width, 3), dict.fromkeys(width, 30))
    same = reusability.duplicate_blocks(files_of(spark, rows)).collect()
    assert Counter((r.repo, r.block, r.n_files, r.first_file, r.first_idx) for r in same) == plain


def test_settings_that_are_lists(spark):
    repos = spark.createDataFrame([("a",), ("b",), ("c",)], "repo string")
    rows = [("a", "clarity", "magic_number_whitelist", " 1, 2.5"), ("a", "functionality", "todo_markers", "X, ,Y"), ("a", "reusability", "block_size", "-3"),
            ("b", "clarity", "magic_number_whitelist", "1,two"), ("b", "clarity", "allowed_single_letter_vars", ""), ("b", "reusability", "block_size", "7")]
    got = {r.repo: r for r in overrides.repo_options(repos, spark.createDataFrame(rows, "repo string, section string, key string, value string")).collect()}
    default = [float(x) for x in fv.MAGIC_NUMBER_WHITELIST]
    assert got["a"].opt_magic_number_whitelist == [1.0, 2.5] and got["b"].opt_magic_number_whitelist == default == got["c"].opt_magic_number_whitelist
    assert got["a"].opt_todo_markers == ["X", "Y"] and got["c"].opt_todo_markers == fv.TODO_MARKERS
    assert (got["a"].opt_block_size, got["b"].opt_block_size, got["b"].opt_allowed_single_letter_vars) == (3, 7, "")


# --- syntax facts --------------------------------------------------------------------------------


def test_files_that_are_nested_too_deeply(spark):
    deep = "x = " + "(" * 5000 + ")" * 5000
    files = files_of(spark, [("r", "deep.py", deep), ("r", "bad.py", "def ("), ("r", "chain.py", "x = " + "-" * (20 * sys.getrecursionlimit()) + "1")])
    notes = {r.path: r.note for r in pyfacts.syntax_notes(pyfacts.syntax_facts(files)).collect()}
    assert notes["bad.py"].endswith("syntax error") and notes["chain.py"].endswith("nested too deeply to be parsed")


def test_texts_are_parsed_once(spark, tmp_path, monkeypatch):
    """Copies share a parse, a second run parses new texts only, and the facts are those of ``syntax_facts``."""
    rows = [("r", f"{i}.py", f"import os\ndef f{i % 3}(): pass\n") for i in range(9)] + [("s", "bad.py", "def ("), ("s", "a.md", "x")]
    rows += [("s", "deep.py", "x = " + "-" * (20 * sys.getrecursionlimit()) + "1"), ("s", "empty.py", "")]
    plain = lambda df: Counter(map(repr, df.collect()))
    table = spark.read.schema("key string")
    asked = []
    monkeypatch.setattr(pyfacts, "syntax_facts", lambda f, s=False, own=pyfacts.syntax_facts: asked.append(f.count()) or own(f, s))
    place = str(tmp_path / "facts")
    first = pyfacts.remembered_facts(files_of(spark, rows), place)
    assert asked == [6] and table.parquet(place + "/plain").count() == 6
    assert plain(first) == plain(pyfacts.syntax_facts(files_of(spark, rows)))
    asked.clear()
    more = files_of(spark, [*rows, ("t", "new.py", "y = 2"), ("t", "old.py", rows[0][2])])
    got = pyfacts.remembered_facts(more, place)
    assert asked == [1] and plain(got) == plain(pyfacts.syntax_facts(more))
    asked.clear()
    assert plain(pyfacts.remembered_facts(more, place)) == plain(got) and not asked
    assert not pyfacts.remembered_facts(more.limit(0), str(tmp_path / "none")).collect()


def test_code_view_uses_all_cores(spark):
    """Its source columns are few bytes, but they become whole files: they stay dealt out, and parsing keeps up with the other checks."""
    code = fixtures.code_files(spark, SMALL)
    assert code.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    facts = pyfacts.syntax_facts(code)
    assert "MapInArrow" in facts._jdf.queryExecution().toString()
    assert facts.count() == code.filter("endswith(path, '.py')").count()


def test_batches_of_a_folder_are_small(tmp_path):
    """A worker holds a few MB of files at a time, and every file comes."""
    make_tree(tmp_path, {f"f{i:02d}.py": b"x" * 400_000 for i in range(60)})
    reader = folder._Rows({"roots": json.dumps({"r": str(tmp_path)})})
    batches = [b for f in folder.planned(reader.roots) for b in reader.read(f)]
    assert max(b.nbytes for b in batches) < 6 * 1024 * 1024
    assert sorted(p for b in batches for p in b.column("path").to_pylist()) == [f"f{i:02d}.py" for i in range(60)]


def test_copied_files_are_parsed_once(spark, monkeypatch):
    """Copies of a short text are parsed once by a worker, and every copy has its facts."""
    text = "import os\ndef f(a=[]):\n    return [x for x in a if x]\n"
    parsed, own = [], pyfacts._facts_of
    monkeypatch.setattr(pyfacts, "_facts_of", lambda content, with_source: parsed.append(content) or own(content, with_source))
    pyfacts._facts_of_short.cache_clear()
    long_text = text + "#" * pyfacts._SHORT
    for content in (text, long_text, text, "def broken(", text, "def broken("):
        assert pyfacts._facts_once(content, False) == own(content, False)
    assert parsed == [text, long_text, "def broken("]
    assert pyfacts._facts_once(text, True) != pyfacts._facts_once(text, False)
    monkeypatch.undo()
    files = files_of(spark, [("r", f"{i}.py", text if i % 2 else f"{text}y = {i}\n") for i in range(200)])
    rows = pyfacts.syntax_facts(files).collect()
    assert len(rows) == 200 and all(r.parsed and r.mutable[0].kind == "list" and r.funcs[0].decisions == 0 for r in rows)
    assert all((list(r.names) == ["y", "x", "a"]) != bool(int(r.path[:-3]) % 2) or "y" in r.names for r in rows)
