"""Repository-scoped checks of the structure, security and automation analyzers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions import text
from lintlake.functions.memo import per_application
from lintlake.operators.findings import ANALYZER_NO, CATEGORY, item
from lintlake.operators.repo_facts import (
    api_opportunity,
    cli_opportunity,
    names_in,
    repo_facts,
    top_level_functions,
)
from lintlake.options import DEFAULTS, Options


@dataclass(frozen=True)
class RepoCheck:
    """A check decided from the facts of one repository."""

    check_id: str
    analyzer: str
    phase: int
    facts: list[str]
    file: str
    condition: Callable[[Options], Column]
    found: Callable[[Options], Column]


def _no_tests() -> Column:
    return (F.col("n_test_py") == 0) & (F.col("n_code_py") > 0)


def _few_tests() -> Column:
    # tests / code < 0.3, in integers
    tests, code = F.col("n_test_py"), F.col("n_code_py")
    return (tests > 0) & (code > 0) & (tests * 10 < code * 3)


def concern_names() -> Column:
    return F.array_sort(names_in(F.col("root_concerns"), fv.CONCERNS))


REPO_CHECKS = [
    RepoCheck(
        "STR1", "Structure", 0, ["n_root_code"], fv.REPO_ROOT,
        lambda o: F.col("n_root_code") > o.root_file_threshold,
        lambda o: item("STR1", n=F.col("n_root_code")),
    ),
    RepoCheck(
        "STR2", "Structure", 1, ["root_concerns"], fv.REPO_ROOT,
        lambda o: F.size(concern_names()) >= o.mixed_concern_threshold,
        lambda o: item("STR2", kinds=F.array_join(concern_names(), ", ")),
    ),
    RepoCheck(
        "STR3", "Structure", 2, ["n_py", "has_packaging"], fv.REPO_ROOT,
        lambda o: (F.col("n_py") > 2) & ~F.col("has_packaging"),
        lambda o: item("STR3"),
    ),
    RepoCheck(
        "SEC3", "Security", 1, ["has_env"], ".env",
        lambda o: F.col("has_env"),
        lambda o: item("SEC3"),
    ),
    RepoCheck(
        "SEC4", "Security", 2, ["has_ignore"], ".gitignore",
        lambda o: ~F.col("has_ignore"),
        lambda o: item("SEC4"),
    ),
    RepoCheck(
        "AUT1", "Automation", 0, ["has_ci"], fv.REPO_ROOT,
        lambda o: ~F.col("has_ci"),
        lambda o: item("AUT1"),
    ),
    RepoCheck(
        "AUT2", "Automation", 1, ["n_test_py", "n_code_py"], fv.REPO_ROOT,
        lambda o: _no_tests() | _few_tests(),
        lambda o: F.when(_no_tests(), item("AUT2", n=F.col("n_code_py"))).otherwise(
            item("AUT2_LOW", tests=F.col("n_test_py"), n=F.col("n_code_py"))
        ),
    ),
    RepoCheck(
        "AUT3", "Automation", 2, ["has_lint"], fv.REPO_ROOT,
        lambda o: ~F.col("has_lint"),
        lambda o: item("AUT3"),
    ),
    RepoCheck(
        "AUT4", "Automation", 3, ["n_hooks"], fv.REPO_ROOT,
        lambda o: F.col("n_hooks") > 0,
        lambda o: item("AUT4", n=F.col("n_hooks")),
    ),
]


@per_application
def _entry(check: RepoCheck, options: Options) -> Column:
    """The check's finding with its order key, null where the condition does not hold."""
    return F.when(
        check.condition(options),
        F.struct(
            F.lit(check.analyzer).alias("analyzer"),
            F.lit(CATEGORY[check.analyzer]).alias("category"),
            F.lit(check.check_id).alias("check_id"),
            F.lit(check.file).alias("file"),
            check.found(options).alias("f"),
            F.struct(
                F.lit(ANALYZER_NO[check.analyzer]).alias("analyzer"),
                F.lit(check.phase).alias("phase"),
                F.lit("").alias("path"),
                F.lit(0).alias("check"),
                F.lit(0).alias("sub"),
            ).alias("ord"),
        ),
    )


def repo_findings(
    files: DataFrame, checks: list[RepoCheck] | None = None, options: Options = DEFAULTS,
    settings: DataFrame | None = None,
) -> DataFrame:
    """Findings of the repository-scoped checks: one aggregate, then one explode.

    ``settings``: one row per repo with the ``opt_`` columns, where options are columns.
    """
    checks = checks or REPO_CHECKS
    facts = repo_facts(files, list(dict.fromkeys(n for c in checks for n in c.facts)))
    facts = facts.join(settings, "repo", "left") if settings is not None else facts
    entries = [_entry(c, options) for c in checks]
    found = text.explode_rows(facts, ["repo"], F.array_compact(F.array(*entries)), "x")
    return found.select(
        "repo", "x.analyzer", "x.category", "x.check_id", "x.file", "x.f.severity", "x.f.title",
        "x.f.description", "x.f.suggestion", "x.f.line", "x.f.code_before",
        F.lit(None).cast("string").alias("code_after"), "x.ord",
    )


# --- notes -----------------------------------------------------------------------------------

NOTE_COLUMNS = ["repo", "analyzer", "path", "sub", "note"]


def ignore_notes(files: DataFrame) -> DataFrame:
    """Recommended ignore entries that a non-empty .gitignore does not mention."""
    missing = names_in(F.col("ignore_entries"), fv.IGNORE_ENTRIES, present=False)
    return (
        repo_facts(files.filter(F.col("path") == ".gitignore"), ["has_ignore", "ignore_entries"])
        .filter(F.col("has_ignore") & (F.size(missing) > 0))
        .select(
            "repo",
            F.lit("Security").alias("analyzer"),
            F.lit(".gitignore").alias("path"),
            F.lit(0).alias("sub"),
            text.fill(fv.NOTE_GITIGNORE, entries=F.array_join(missing, ", ")).alias("note"),
        )
    )


def hook_notes(files: DataFrame) -> DataFrame:
    """Per file: entry points without a command line, and modules worth an API."""
    path, content = F.col("path"), F.col("content")
    notes = F.array_compact(F.array(
        F.when(cli_opportunity(content), text.fill(fv.NOTE_CLI, path=path)),
        F.when(
            api_opportunity(content),
            text.fill(fv.NOTE_API, path=path, n=top_level_functions(content)),
        ),
    ))
    numbered = F.transform(notes, lambda note, i: F.struct(i.alias("sub"), note.alias("note")))
    return text.inline_rows(files, ["repo", "path"], numbered).select(
        "repo", F.lit("Automation").alias("analyzer"), "path", "sub", "note"
    )
