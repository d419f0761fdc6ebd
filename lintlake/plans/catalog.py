"""The query catalog: one callable ``(spark, sf_dir) -> DataFrame`` per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake import sinks
from lintlake.functions import text
from lintlake.functions.ranking import durable, shared_dir
from lintlake.operators import (
    answers,
    cost,
    patches,
    projects,
    prompts,
    pyfacts,
    repo_checks,
    report,
    reusability,
    scoring,
    testgen,
    trends,
)
from lintlake.operators.findings import (
    exploded_lines,
    file_findings,
    next_text_line,
    union_all,
    with_lines,
)
from lintlake.operators.repo_facts import concern
from lintlake.options import DEFAULTS
from lintlake.plans import smart
from lintlake.plans.checks import FILE_CHECKS, all_findings, all_notes, register_check, unregister_check
from lintlake.sources import files as src
from lintlake.sources import fixtures as fx
from lintlake.sources import folder, history, overrides

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CHECK_COLUMNS = ["repo", "file", "severity", "title", "description", "suggestion", "line"]
AS_OF = "2024-01-25"
GENERATED = "2024-01-31 00:00"


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


_CHECKS = {c.check_id: c for c in FILE_CHECKS}


def _file_check(files: DataFrame, *check_ids: str) -> DataFrame:
    return file_findings(files, [_CHECKS[c] for c in check_ids])


def _both(spark: SparkSession, d: str) -> DataFrame:
    """Code files and documents in one files table."""
    return fx.code_files(spark, d).unionByName(fx.docs_files(spark, d))


def _code_and_pages(spark: SparkSession, d: str) -> DataFrame:
    return fx.code_files(spark, d).unionByName(fx.page_files(spark, d))


def _code_file_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the file-scoped checks on code: the input of the answer jobs."""
    return file_findings(fx.code_files(spark, d), FILE_CHECKS)


def _docs_secrets(spark: SparkSession, d: str) -> DataFrame:
    return _file_check(fx.docs_files(spark, d), "SEC1")


def _stored_findings(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """The findings, computed once and stored, for jobs that read them several times."""
    return durable(all_findings(files, facts=facts))


def _card(spark: SparkSession, d: str) -> DataFrame:
    code = fx.code_files(spark, d)
    return scoring.scorecard(all_findings(code), code)


# --- sources ---------------------------------------------------------------------------------


@query("src1_files_table")
def _(spark, d):
    return fx.docs_files(spark, d).select("repo", "path", "size", F.md5("content").alias("content_md5"))


def _ingested(spark: SparkSession, d: str) -> DataFrame:
    """The documents, written as files and read back through the folder source, stored once."""
    place = f"{shared_dir(spark).removeprefix('file://')}/tree-{uuid.uuid4().hex}"
    folder.ingest(spark, fx.document_tree(spark, d, f"{place}/files"), f"{place}/rows", parts=100)
    return spark.read.parquet(f"{place}/rows")


@query("src1_directory")
def _(spark, d):
    return folder.taken(_ingested(spark, d)).select("repo", "path", "size", F.md5("content").alias("content_md5"))


@query("src1_refused_files")
def _(spark, d):
    return folder.refused(_ingested(spark, d))


@query("src2_suffix_filter")
def _(spark, d):
    return fx.code_files_raw(spark, d).filter(src.has_collected_name(F.col("path"))).select("repo", "path")


@query("src3_skip_dirs")
def _(spark, d):
    return fx.code_files_raw(spark, d).filter(src.outside_skipped_dirs(F.col("path"))).select("repo", "path")


@query("src4_size_guard")
def _(spark, d):
    rows = fx.docs_files(spark, d).unionByName(fx.code_files_raw(spark, d).drop("doc_id"))
    return rows.filter(src.within_size(F.col("size"))).select("repo", "path", "size")


@query("src5_decode")
def _(spark, d):
    crlf = F.replace(F.col("content"), F.lit("\n"), F.lit("\r\n"))
    raw = F.concat(F.encode(crlf, "UTF-8"), F.unhex(F.lit("FF")))
    return fx.docs_files(spark, d).select("repo", "path", F.md5(src.decode(raw)).alias("content_md5"))


@query("src6_forward_slashes")
def _(spark, d):
    windows = F.replace(F.col("path"), F.lit("/"), F.lit("\\"))
    return fx.code_files_raw(spark, d).select("repo", src.normalize_path(windows).alias("path"))


@query("src7_read_history")
def _(spark, d):
    return history.parse_history(fx.history_documents(spark, d)).drop("run_id")


_OPTION_DEFAULTS = {
    ("clarity", "nesting_threshold"): str(DEFAULTS.nesting_threshold),
    ("clarity", "max_function_lines"): str(DEFAULTS.max_function_lines),
    ("structure", "root_file_threshold"): str(DEFAULTS.root_file_threshold),
}


@query("src8_config_lookup")
def _(spark, d):
    repos = scoring.repos_of(fx.code_files(spark, d))
    chosen = overrides.effective_overrides(repos, fx.override_tables(spark, d))
    return overrides.option_values(repos, chosen, _OPTION_DEFAULTS)


def _settings(spark: SparkSession, d: str) -> DataFrame:
    repos = scoring.repos_of(fx.code_files(spark, d))
    return overrides.repo_options(repos, overrides.effective_overrides(repos, fx.override_tables(spark, d)))


@query("src8_effective_checks")
def _(spark, d):
    code, settings, options = fx.code_files(spark, d), _settings(spark, d), overrides.column_options()
    checks = [_CHECKS[c] for c in ("CLA2", "CLA5")]
    root = [c for c in repo_checks.REPO_CHECKS if c.check_id == "STR1"]
    found = union_all([
        file_findings(code.join(settings, "repo"), checks, options),
        repo_checks.repo_findings(code, root, options, settings),
    ])
    return found.select("repo", "check_id", "file", "description", "line")


def _style(spark: SparkSession, files: DataFrame, d: str) -> DataFrame:
    """The files with the settings of their repo as columns."""
    return files.join(overrides.repo_options(scoring.repos_of(files), fx.style_overrides(spark, d)), "repo")


@query("src8_style_checks")
def _(spark, d):
    code, options = _style(spark, fx.code_files(spark, d), d), overrides.column_options()
    found = union_all([
        file_findings(code, [_CHECKS[c] for c in ("CLA1", "CLA4", "FUN1")], options),
        reusability.repeated_import_findings(code, options),
    ])
    return found.select("repo", "check_id", "file", "description", "line")


@query("reu1_per_repo_blocks")
def _(spark, d):
    docs = _style(spark, fx.docs_files(spark, d), d)
    return reusability.duplicate_blocks(docs, overrides.column_options()).select(
        "repo", F.md5("block").alias("block_md5"), "n_files", "first_file", "first_idx", "block_size"
    )


@query("src9_portfolio_repos")
def _(spark, d):
    return projects.portfolio_repos(scoring.repos_of(fx.docs_files(spark, d)), ["src3", "src7"])


@query("src10_scan_projects")
def _(spark, d):
    return projects.scan_projects(fx.project_listing(spark, d))


def _git_projects(spark: SparkSession, d: str) -> DataFrame:
    commits = fx.event_commits(spark, d)
    changes = commits.filter((F.col("message") == "error") & (F.col("commit_id") % 3 == 0))
    return projects.last_commits(commits, changes)


@query("src11_last_commit")
def _(spark, d):
    return _git_projects(spark, d)


# --- sinks -----------------------------------------------------------------------------------


@query("snk1_metadata")
def _(spark, d):
    code = fx.code_files(spark, d)
    found = _stored_findings(code)
    rows = sinks.metadata(
        scoring.scorecard(found, code), scoring.analyzer_scores(found, scoring.repos_of(code))
    )
    return rows.select(
        "repo_path", "files_analyzed", "total_findings", "scores.*", "tag", "recommendation",
        F.col("analyzer_scores")["Security"].alias("security_analyzer"),
        F.col("analyzer_scores")["AST Analysis"].alias("ast_analyzer"),
        "mode", "auto_fix", "fixes_applied",
    )


def _report(spark: SparkSession, d: str) -> DataFrame:
    code = fx.code_files(spark, d)
    facts = durable(pyfacts.syntax_facts(code))
    found = _stored_findings(code, facts)
    cards = durable(scoring.scorecard(found, code))
    return report.report_lines(found, cards, report.describe(code), durable(all_notes(code, facts)), GENERATED)


@query("snk2_report_lines")
def _(spark, d):
    return report.in_order(_report(spark, d)).select("repo", "section", "line")


@query("snk3_portfolio_csv")
def _(spark, d):
    return scoring.portfolio_order(scoring.portfolio(_card(spark, d)))


@query("snk4_append_run")
def _(spark, d):
    runs = fx.event_runs(spark, d)
    cards = runs.select(
        "repo", "run_ts", "run_id", "quality", "structure", "security", "usefulness",
        F.when(F.col("run_id") % 5 != 0, F.col("overall")).alias("overall"),
        F.col("findings_count").alias("total"), F.col("files_analyzed").alias("n_files"),
    )
    return history.new_run(cards, F.col("run_ts"), F.col("run_id"))


@query("snk5_session_summary")
def _(spark, d):
    found = projects.detect_projects(fx.code_files_raw(spark, d))
    n = F.regexp_extract("repo", r"(\d+)", 1).cast("int")
    session = found.withColumn(
        "status", F.when((F.col("status") == "ready") & (n % 2 == 0), "launched")
        .when(F.col("status") == "ready", "failed").otherwise(F.col("status"))
    ).withColumn("review", F.when(n % 5 == 0, "pass").otherwise(""))
    return projects.session_summary(session)


def _patches_of(docs: DataFrame) -> DataFrame:
    fixes = patches.fixable(_file_check(docs, "SEC1"), docs)
    replies = fx.fix_answers(docs, fv.SECRET_PATTERNS[0][0])
    return patches.proposed(fixes, docs, replies)


def _docs_patches(spark: SparkSession, d: str) -> DataFrame:
    return _patches_of(fx.docs_files(spark, d))


@query("snk6_patched_files")
def _(spark, d):
    docs = fx.docs_files(spark, d)
    return patches.patched_files(_docs_patches(spark, d), docs).select(
        "repo", "path", "size", F.md5("content").alias("content_md5")
    )


@query("snk6_bucketed_files")
def _(spark, d):
    name = f"files_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = sinks.write_bucketed_files(fx.docs_files(spark, d), name, f"{shared_dir(spark)}/{name}", buckets)
    return patches.patched_files(_patches_of(docs), docs).select(
        "repo", "path", "size", F.md5("content").alias("content_md5")
    )


@query("snk7_generated_test_files")
def _(spark, d):
    tests = testgen.generated_tests(testgen.answered_tests(fx.test_answers(spark, d)))
    return sinks.generated_test_files(tests)


# --- row kernels -----------------------------------------------------------------------------


@query("k1_lines")
def _(spark, d):
    return exploded_lines(fx.docs_files(spark, d)).select(
        "repo", "path", "line_no", F.md5("text").alias("text_md5")
    )


@query("k2_strip")
def _(spark, d):
    # Odd whitespace is put around every line so that trimming has something to do.
    wrapped = F.concat(F.lit("\t \xa0 "), F.col("text"), F.lit(" \x0b　\t"))
    return exploded_lines(fx.docs_files(spark, d)).select(
        "repo", "path", "line_no", F.md5(text.strip(wrapped)).alias("stripped_md5"),
    )


@query("k3_match_lines")
def _(spark, d):
    hits = lambda pattern: text.explode_rows(
        fx.docs_files(spark, d), ["repo", "path"], text.match_lines(F.col("content"), pattern), "line"
    )
    rows = hits(fv.SECRET_PATTERNS[0][0])
    # Every sentence end, to have many hits per text.
    dots = hits(r"[a-z]\.\n?")
    return union_all([rows, dots]).groupBy("repo", "path", "line").agg(F.count(F.lit(1)).alias("n_hits"))


@query("k4_indent")
def _(spark, d):
    rows = exploded_lines(fx.code_files(spark, d))
    width = text.indent_width(F.col("text"))
    return rows.select("repo", "path", "line_no", width.alias("width"), F.floor(width / 4).cast("int").alias("depth"))


@query("k5_next_text_line")
def _(spark, d):
    pairs = F.transform(F.col("ln"), lambda x: F.struct(
        x["no"].alias("line"), next_text_line(x, 4)["no"].alias("next_line")))
    return text.inline_rows(with_lines(fx.code_files(spark, d)), ["repo", "path"], pairs)


@query("k6_paths")
def _(spark, d):
    p = F.col("path")
    return fx.code_files_raw(spark, d).select(
        "repo", "path", text.basename(p).alias("base"), text.dirname(p).alias("dir"),
        text.suffix(p).alias("suffix"), text.stem(p).alias("stem"),
    )


# --- checks ----------------------------------------------------------------------------------

_CHECK_QUERIES = {
    "sec1_secrets": ("SEC1", _both),
    "sec2_unsafe_calls": ("SEC2", fx.code_files),
    "fun1_open_markers": ("FUN1", fx.code_files),
    "fun2_stub_functions": ("FUN2", fx.code_files),
    "fun3_swallowed_exceptions": ("FUN3", fx.code_files),
    "fun4_unused_imports": ("FUN4", fx.code_files),
    "fun5_dead_code": ("FUN5", fx.code_files),
    "cla1_single_letters": ("CLA1", _code_and_pages),
    "cla2_long_functions": ("CLA2", fx.code_files),
    "cla3_missing_docstrings": ("CLA3", fx.code_files),
    "cla4_magic_numbers": ("CLA4", lambda s, d: _both(s, d).unionByName(fx.page_files(s, d))),
    "cla5_deep_nesting": ("CLA5", fx.code_files),
    "str4_hardcoded_constants": ("STR4", fx.code_files),
    "reu3_inline_logic": ("REU3", lambda s, d: _both(s, d).unionByName(fx.page_files(s, d))),
}

for _name, (_check_id, _files) in _CHECK_QUERIES.items():
    QUERIES[_name] = lambda spark, d, c=_check_id, f=_files: _file_check(f(spark, d), c).select(*CHECK_COLUMNS)

_REPO_QUERIES = {
    "sec3_env_file": "SEC3",
    "sec4_ignore_file": "SEC4",
    "str1_flat_structure": "STR1",
    "str2_mixed_concerns": "STR2",
    "str3_missing_packaging": "STR3",
    "aut1_ci": "AUT1",
    "aut2_tests": "AUT2",
    "aut3_lint": "AUT3",
    "aut4_hook_points": "AUT4",
}


def _repo_check(spark: SparkSession, d: str, check_id: str) -> DataFrame:
    chosen = [c for c in repo_checks.REPO_CHECKS if c.check_id == check_id]
    return repo_checks.repo_findings(fx.code_files(spark, d), chosen).select(*CHECK_COLUMNS)


for _name, _check_id in _REPO_QUERIES.items():
    QUERIES[_name] = lambda spark, d, c=_check_id: _repo_check(spark, d, c)


@query("sec4_ignore_notes")
def _(spark, d):
    return repo_checks.ignore_notes(fx.code_files(spark, d)).select("repo", "note")


@query("aut4_hook_notes")
def _(spark, d):
    return repo_checks.hook_notes(fx.code_files(spark, d)).select("repo", "path", "note")


@query("reu1_duplicate_blocks")
def _(spark, d):
    return reusability.duplicate_block_findings(fx.docs_files(spark, d)).select(
        *CHECK_COLUMNS, "code_before"
    )


@query("reu1_block_files")
def _(spark, d):
    return reusability.block_files(fx.docs_files(spark, d)).select("repo", "block", "path", "n_files")


@query("reu1_corpus_blocks")
def _(spark, d):
    return reusability.duplicate_blocks(fx.docs_files(spark, d), scope="corpus").select(
        "block", "n_files", "first_file"
    )


@query("reu2_repeated_imports")
def _(spark, d):
    return reusability.repeated_import_findings(fx.code_files(spark, d)).select(*CHECK_COLUMNS)


@query("reu2_import_set_files")
def _(spark, d):
    return reusability.import_set_files(fx.code_files(spark, d)).select("repo", "imports", "path", "n_files")


# --- syntax facts ----------------------------------------------------------------------------


def _fact_counts(facts: DataFrame) -> DataFrame:
    return facts.select(
        "repo", "path", "parsed", F.size("imports").alias("n_imports"), F.size("exports").alias("n_exports"),
        F.size("guarded").alias("n_guarded"), F.size("funcs").alias("n_funcs"),
        F.size("mutable").alias("n_mutable"),
    )


@query("ast0_facts")
def _(spark, d):
    return _fact_counts(pyfacts.syntax_facts(fx.code_files(spark, d)))


@query("ast0_remembered_facts")
def _(spark, d):
    return _fact_counts(pyfacts.remembered_facts(fx.code_files(spark, d), f"{shared_dir(spark)}/facts-{uuid.uuid4().hex}"))


@query("ast0_syntax_notes")
def _(spark, d):
    return pyfacts.syntax_notes(pyfacts.syntax_facts(fx.code_files(spark, d))).select("repo", "note")


for _name, _check_id in {
    "ast1_unused_imports": "AST1",
    "ast2_complexity": "AST2",
    "ast3_function_length": "AST3",
    "ast4_return_types": "AST4",
    "ast5_mutable_defaults": "AST5",
}.items():
    QUERIES[_name] = lambda spark, d, c=_check_id: pyfacts.fact_findings(
        pyfacts.syntax_facts(fx.code_files(spark, d)), [c]
    ).select(*CHECK_COLUMNS)


# --- joins -----------------------------------------------------------------------------------


@query("jn1_finding_content")
def _(spark, d):
    docs = fx.docs_files(spark, d)
    found = union_all([_docs_secrets(spark, d), reusability.duplicate_block_findings(docs)])
    sizes = docs.select("repo", "path", F.length("content").alias("n_chars"))
    keyed = answers.with_file(found.withColumn("key", answers.file_key(F.col("file"))), sizes)
    return keyed.select("repo", "key", "title", "line", "n_chars")


def _validated(spark: SparkSession, d: str) -> DataFrame:
    code = fx.code_files(spark, d)
    found = durable(_code_file_findings(spark, d))
    return answers.validated(found, code, fx.verdict_answers(found))


@query("jn2_validated_findings")
def _(spark, d):
    return _validated(spark, d).select(*CHECK_COLUMNS)


def _smart(spark: SparkSession, d: str) -> smart.SmartRun:
    """A reviewed run of which a query makes the tables that it reads."""
    code = fx.code_files(spark, d)
    return smart.SmartRun(code, fx.verdict_answers, fx.review_answers(code), f"{shared_dir(spark)}/smart-{uuid.uuid4().hex}")


@query("jn2_all_findings_validated")
def _(spark, d):
    return _smart(spark, d).validated.select("check_id", *CHECK_COLUMNS)


@query("e1_smart_scorecard")
def _(spark, d):
    return _smart(spark, d).cards.select(
        "repo", "overall", "tag", "recommendation", "n_files", "total", "critical", "high", "n_before", "n_dismissed", "n_added", "ai_score"
    )


@query("e1_smart_top_findings")
def _(spark, d):
    return scoring.top_findings(_smart(spark, d).kept).select("repo", "rank", "analyzer", "file", "severity", "title", "description", "line")


@query("agg1_ai_score")
def _(spark, d):
    return smart.review_scores(_smart(spark, d).review)


@query("jn3_fixable")
def _(spark, d):
    docs = fx.docs_files(spark, d)
    found = union_all([
        _docs_secrets(spark, d), reusability.duplicate_block_findings(docs), _file_check(docs, "CLA4"),
    ])
    return patches.fixable(found, docs).select(*CHECK_COLUMNS)


@query("jn4_skip_list")
def _(spark, d):
    repos = scoring.repos_of(fx.docs_files(spark, d))
    skip = fx.docs_files(spark, d).groupBy("repo").agg(F.count_if(F.col("content").contains("license")).alias("n"))
    return repos.join(skip.filter(F.col("n") > 0).select("repo"), "repo", "left_anti").select("repo", "n_files")


@query("jn5_guarded_imports")
def _(spark, d):
    facts = pyfacts.syntax_facts(fx.code_files(spark, d))
    inside = F.transform(F.col("imports"), lambda i: F.struct(
        i["name"].alias("name"), i["line"].alias("line"),
        F.exists("guarded", lambda g: (i["line"] >= g["lo"]) & (i["line"] <= g["hi"])).alias("guarded"),
    ))
    return facts.select("repo", "path", F.inline(inside))


@query("jn6_regrouped")
def _(spark, d):
    return answers.by_analyzer(_validated(spark, d))


@query("jn7_patch_titles")
def _(spark, d):
    return _docs_patches(spark, d).select("repo", "path", "seq", "finding")


@query("jn8_previous_run")
def _(spark, d):
    return trends.with_previous(fx.event_runs(spark, d)).select(
        "repo", "run_ts", "run_id", "overall", F.col("prev.overall").alias("previous_overall")
    )


# --- aggregates and scores -------------------------------------------------------------------


@query("agg1_analyzer_scores")
def _(spark, d):
    code = fx.code_files(spark, d)
    return scoring.analyzer_scores(all_findings(code), scoring.repos_of(code))


@query("agg2_repo_scores")
def _(spark, d):
    code = fx.code_files(spark, d)
    return scoring.repo_scores(all_findings(code), scoring.repos_of(code)).drop("n_files")


@query("agg2_weighted_scores")
def _(spark, d):
    code = fx.code_files(spark, d)
    repos = scoring.repos_of(code).join(_settings(spark, d), "repo")
    return scoring.repo_scores(all_findings(code), repos, overrides.column_options()).select("repo", "overall")


@query("agg3_tags")
def _(spark, d):
    return scoring.tags(_both(spark, d))


@query("agg4_recommendations")
def _(spark, d):
    return _card(spark, d).select("repo", "overall", "n_files", "recommendation")


@query("agg5_severity_counts")
def _(spark, d):
    code = fx.code_files(spark, d)
    return scoring.severity_counts(union_all([all_findings(code), _docs_secrets(spark, d)]))


@query("agg6_findings_by_file")
def _(spark, d):
    return scoring.findings_by_file(all_findings(fx.code_files(spark, d)))


@query("agg7_notes")
def _(spark, d):
    return report.prefixed_notes(all_notes(fx.code_files(spark, d))).select("repo", "entry")


def _project_rows(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("repo", r"(\d+)", 1).cast("int")
    return (
        projects.detect_projects(fx.code_files_raw(spark, d))
        .withColumn("is_git", n % 3 == 0)
        .withColumn("has_uncommitted", n % 4 == 1)
    )


@query("agg8_dashboard")
def _(spark, d):
    return projects.dashboard_summary(_project_rows(spark, d))


@query("agg9_history_summary")
def _(spark, d):
    return trends.history_summary(fx.event_runs(spark, d))


@query("agg10_cost_smart")
def _(spark, d):
    return cost.estimate_cost(fx.docs_files(spark, d), "smart")


@query("agg10_cost_auto_fix")
def _(spark, d):
    return cost.estimate_cost(fx.docs_files(spark, d), "auto-fix")


@query("agg11_ai_summary")
def _(spark, d):
    code = fx.code_files(spark, d)
    reviews = answers.review_findings(fx.review_answers(code))
    return answers.dismissal_counts(_code_file_findings(spark, d), _validated(spark, d), reviews)


@query("agg12_totals")
def _(spark, d):
    code = fx.code_files(spark, d)
    totals = scoring.severity_counts(all_findings(code)).select("repo", F.col("total").alias("total_findings"))
    return scoring.repos_of(code).join(totals, "repo", "left").na.fill(0, ["total_findings"])


@query("agg13_test_totals")
def _(spark, d):
    return testgen.test_totals(testgen.answered_tests(fx.test_answers(spark, d)))


@query("agg13_patch_totals")
def _(spark, d):
    return patches.patch_totals(_docs_patches(spark, d))


@query("agg14_files_per_block")
def _(spark, d):
    rows = reusability.duplicate_blocks(fx.docs_files(spark, d))
    return rows.select("repo", F.md5("block").alias("block_md5"), "n_files")


# --- windows ---------------------------------------------------------------------------------


@query("win1_trends")
def _(spark, d):
    return trends.trend_rows(fx.event_runs(spark, d)).drop("category_no")


@query("win1_latest_trends")
def _(spark, d):
    return trends.trend_rows(fx.event_runs(spark, d), latest_only=True).drop("category_no")


@query("win1_trend_section")
def _(spark, d):
    return trends.trend_section(fx.event_runs(spark, d))


@query("win2_blocks")
def _(spark, d):
    cut = fx.docs_files(spark, d).select("repo", "path", reusability._code_lines().alias("code"))
    rows = text.inline_rows(cut, ["repo", "path"], reusability.windows(F.col("code"), DEFAULTS))
    return rows.select("repo", "path", "idx", F.md5("block").alias("block_md5"))


@query("win3_function_spans")
def _(spark, d):
    pattern = text.java_pattern(fv.DEF_PATTERN)
    defs = F.filter(F.col("ln"), lambda x: x["raw"].rlike(pattern))
    spans = F.transform(F.col("defs"), lambda x, i: F.struct(
        x["no"].alias("line"), F.regexp_extract(x["raw"], pattern, 1).alias("name"),
        (F.coalesce(F.get(F.col("defs"), i + 1)["no"], F.col("n") + 1) - x["no"]).alias("n_lines")))
    rows = with_lines(fx.code_files(spark, d)).select("repo", "path", defs.alias("defs"), F.size("ln").alias("n"))
    return text.inline_rows(rows, ["repo", "path"], spans)


@query("win4_finding_index")
def _(spark, d):
    docs = fx.docs_files(spark, d)
    found = union_all([_docs_secrets(spark, d), reusability.duplicate_block_findings(docs)])
    return answers.indexed(found).select("repo", "key", "idx", "title", "line", F.md5("file").alias("file_md5"))


@query("win5_review_budget")
def _(spark, d):
    return prompts.review_budget(_review_files(spark, d))


def _review_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents under reviewable names, next to the code."""
    docs = fx.docs_files(spark, d).withColumn("path", F.regexp_replace("path", r"\.txt$", ".py"))
    return docs.unionByName(fx.code_files(spark, d))


# --- top-k, sorts, sets ----------------------------------------------------------------------


@query("top1_top_findings")
def _(spark, d):
    found = union_all([all_findings(fx.code_files(spark, d)), _docs_secrets(spark, d)])
    return scoring.top_findings(found).select("repo", "rank", "file", "severity", "title", "line")


@query("top2_portfolio_ranking")
def _(spark, d):
    return scoring.portfolio_order(scoring.portfolio(_card(spark, d))).select("Repo", "Score")


@query("top3_first_names")
def _(spark, d):
    return _file_check(fx.code_files(spark, d), "CLA3", "FUN4").select("repo", "file", "title", "description")


@query("top4_truncation")
def _(spark, d):
    cut = lambda n: F.md5(F.substring("content", 1, n))
    return fx.docs_files(spark, d).select(
        "repo", "path", cut(fv.DESCRIPTION_LENGTH).alias("d300"), cut(fv.VALIDATION_CONTEXT_CHARS).alias("d8000"),
        cut(fv.REVIEW_SNIPPET_CHARS).alias("d6000"),
    )


@query("top5_sorted_files")
def _(spark, d):
    return fx.docs_files(spark, d).select("repo", "path").orderBy("repo", "path")


@query("set1_all_findings")
def _(spark, d):
    return all_findings(fx.code_files(spark, d)).select("analyzer", "category", "check_id", *CHECK_COLUMNS, "code_before")


@query("ext1_custom_check")
def _(spark, d):
    def long_files(files: DataFrame) -> DataFrame:
        none = F.lit(None)
        return files.filter(F.col("size") > 1000).select(
            "repo", F.lit("Custom").alias("analyzer"), F.lit("custom").alias("category"), F.lit("EXT_LONG").alias("check_id"),
            F.col("path").alias("file"), F.lit("low").alias("severity"), F.lit("Long file").alias("title"),
            F.concat("size", F.lit(" bytes")).alias("description"), F.lit("Split it").alias("suggestion"),
            none.alias("line"), none.alias("code_before"), none.alias("code_after"),
            F.struct(F.lit(99), F.lit(0), F.col("path"), F.lit(0), F.lit(0)).alias("ord"),
        )

    register_check("EXT_LONG", "Custom", "file", long_files)
    try:
        found = all_findings(fx.code_files(spark, d))
    finally:
        unregister_check("EXT_LONG")
    return found.filter(F.col("check_id") == "EXT_LONG").select(
        "repo", "analyzer", "check_id", "file", "severity", "title", "description"
    )


@query("set2_missing_ignore_entries")
def _(spark, d):
    entries = F.array(*[F.lit(e) for e in fv.IGNORE_ENTRIES])
    return (
        fx.code_files(spark, d).filter((F.col("path") == ".gitignore") & (F.col("size") > 0))
        .select("repo", F.explode(F.filter(entries, lambda e: ~F.contains("content", e))).alias("entry"))
    )


@query("set3_distinct_kinds")
def _(spark, d):
    code = fx.code_files(spark, d).filter(text.is_root(F.col("path")))
    kind = F.element_at(F.array(*[F.lit(c) for c in fv.CONCERNS]), concern(F.col("path"), F.col("content")) + 1)
    return code.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"))


# --- report rows -----------------------------------------------------------------------------


@query("rep1_descriptions")
def _(spark, d):
    return report.describe(fx.code_files(spark, d))


@query("rep2_plan_rows")
def _(spark, d):
    code = fx.code_files(spark, d)
    return report.plan_rows(_stored_findings(code), scoring.repos_of(code)).select("repo", "priority", "entry")


@query("rep3_entries")
def _(spark, d):
    return all_findings(fx.code_files(spark, d)).select(
        "repo", "file", report.file_entry().alias("entry"),
        F.upper("severity").alias("severity_label"), report.line_suffix(F.col("line")).alias("line_suffix"),
    )


@query("rep4_spliced_report")
def _(spark, d):
    code = fx.code_files(spark, d)
    facts = durable(pyfacts.syntax_facts(code))
    found = _stored_findings(code, facts)
    cards = durable(scoring.scorecard(found, code))
    tests = testgen.test_lines(testgen.answered_tests(fx.test_answers(spark, d)))
    runs = fx.event_runs(spark, d).withColumn(
        "repo", F.concat(F.lit("src"), F.regexp_extract("repo", r"(\d+)", 1).cast("int") % 20)
    )
    trend = trends.trend_section(runs).select(
        "repo", F.lit(0).alias("block"), F.lit("").alias("name"), "line_no", "line"
    )
    lines = report.report_lines(
        found, cards, report.describe(code), durable(all_notes(code, facts)), GENERATED, smart=True,
        extra={report.TESTS: tests, report.TREND: trend},
    )
    return report.in_order(lines).select("repo", "section", "line")


# --- prompts and answers ---------------------------------------------------------------------


@query("prm1_validation_prompts")
def _(spark, d):
    return prompts.validation_prompts(_docs_secrets(spark, d), fx.docs_files(spark, d))


@query("prm2_review_prompt_parts")
def _(spark, d):
    return prompts.review_prompt_parts(_review_files(spark, d)).select(
        "repo", "part", "path", F.md5("text").alias("text_md5")
    )


@query("prm3_fix_prompts")
def _(spark, d):
    docs = fx.docs_files(spark, d)
    return prompts.fix_prompts(patches.fixable(_docs_secrets(spark, d), docs), docs)


@query("prm4_test_prompts")
def _(spark, d):
    return prompts.test_prompts(pyfacts.public_functions(fx.code_files(spark, d)))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    return fx.verdict_answers(_code_file_findings(spark, d))


@query("ans1_unfenced")
def _(spark, d):
    fenced = F.concat(F.lit(" ```text\n"), F.col("content"), F.lit("\n```\ntrailing words"))
    kind = F.regexp_extract("path", r"(\d+)\.", 1).cast("int") % 3
    reply = F.when(kind == 0, fenced).when(kind == 1, F.col("content")).otherwise("```one line")
    return fx.docs_files(spark, d).select(
        "repo", "path", F.md5(answers.unfenced(reply)).alias("body_md5")
    )


@query("ans2_review_findings")
def _(spark, d):
    return answers.review_findings(fx.review_answers(fx.docs_files(spark, d))).select(
        "category", *CHECK_COLUMNS
    )


@query("ans2_parsed_verdicts")
def _(spark, d):
    return _replies(spark, d).select(
        "repo", "key", F.inline(answers.parsed(F.col("text"), answers.VERDICTS))
    )


@query("ans2_mixed_verdicts")
def _(spark, d):
    code = fx.code_files(spark, d)
    found = durable(_code_file_findings(spark, d))
    replies = fx.with_broken_entries(fx.verdict_answers(found))
    return answers.validated(found, code, replies).select(*CHECK_COLUMNS)


@query("ans3_patches")
def _(spark, d):
    return _docs_patches(spark, d)


@query("fix1_dry_run")
def _(spark, d):
    return patches.apply_patches(_docs_patches(spark, d), fx.docs_files(spark, d), dry_run=True)


@query("fix1_applied")
def _(spark, d):
    return patches.apply_patches(_docs_patches(spark, d), fx.docs_files(spark, d), dry_run=False)


@query("fix2_patch_report")
def _(spark, d):
    done = patches.apply_patches(_docs_patches(spark, d), fx.docs_files(spark, d), dry_run=True)
    return patches.patch_lines(done)


@query("rep4_patches_section")
def _(spark, d):
    # Stored, as the section reads the patches for the heads and for the lines.
    done = durable(patches.apply_patches(_docs_patches(spark, d), fx.docs_files(spark, d), dry_run=True))
    return patches.patch_section(done, scoring.repos_of(_both(spark, d)))


@query("e1_smart_patches_section")
def _(spark, d):
    code, place = fx.code_files(spark, d), f"{shared_dir(spark)}/smart-{uuid.uuid4().hex}"
    run = smart.SmartRun(code, fx.verdict_answers, fx.review_answers(code), place)
    return smart.smart_patches(run, code, lambda wanted: fx.fix_answers(code, fv.SECRET_PATTERNS[0][0]), place)[1]


@query("tst1_public_functions")
def _(spark, d):
    return pyfacts.public_functions(fx.code_files(spark, d)).select(
        "repo", "path", "name", "class", "line", "source", "is_async"
    )


@query("tst2_test_paths")
def _(spark, d):
    tests = testgen.generated_tests(testgen.answered_tests(fx.test_answers(spark, d)))
    return tests.select("repo", "test_path", "source_path", "num_tests")


@query("tst3_test_report")
def _(spark, d):
    return testgen.test_lines(testgen.answered_tests(fx.test_answers(spark, d)), written=True)


# --- projects --------------------------------------------------------------------------------


@query("prj1_project_types")
def _(spark, d):
    return projects.detect_projects(fx.code_files_raw(spark, d))


@query("prj2_content_probe")
def _(spark, d):
    return fx.code_files_raw(spark, d).groupBy("repo").agg(
        projects.file_contains(F.col("path"), F.col("content"), F.col("size"), "import json").alias("found")
    )


@query("prj3_recent_projects")
def _(spark, d):
    commits = fx.event_commits(spark, d)
    repos = commits.groupBy("repo").agg(F.bool_or("is_git").alias("is_git"))
    rows = repos.join(projects.last_commits(commits).drop("has_uncommitted"), "repo", "left")
    as_of: Column = F.lit(AS_OF).cast("date") + F.lit(5)
    return projects.recent_projects(rows, as_of, 1)


@query("prj4_by_name")
def _(spark, d):
    found = projects.detect_projects(fx.code_files_raw(spark, d))
    named = projects.by_name(found, "SRC4").select("repo", F.lit("named").alias("why"))
    return named.unionByName(projects.launchable(found).select("repo", F.lit("launchable").alias("why")))


@query("prj5_color_bands")
def _(spark, d):
    return _card(spark, d).select("repo", "overall", scoring.color_band(F.col("overall")).alias("band"))
