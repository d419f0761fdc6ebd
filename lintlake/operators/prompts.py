"""Prompt tables for the external reviewer: one row per request (or per part of a long request)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions import text
from lintlake.functions.ranking import within_budget
from lintlake.operators.answers import indexed

_VALIDATE = """Check each numbered finding against this file.

FILE: {path}
```
{content}
```

FINDINGS TO VALIDATE:
{findings}

Answer with a JSON array only. One object per finding: "index" (its number), "valid" (false for a false
alarm), "reason" (short), "improved_suggestion" (a better fix, or null)."""

_FIX = """Propose small patches for the numbered issues in this file.

FILE: {path}
```
{content}
```

ISSUES TO FIX:
{findings}

Answer with a JSON array only. One object per patch: "finding_index" (number of the issue), "original" (text
copied from the file, occurring once), "fixed" (its replacement), "explanation" (short). Leave out issues
that cannot be fixed safely."""

_REVIEW_HEAD = """Review this code base for problems a static check cannot see.
"""

_REVIEW_TAIL = """
Answer with a JSON array only, at most 10 objects: "file", "severity" (critical, high, medium or low), "title",
"description", "suggestion", "line" (number or null). Long files are shortened for this request."""

_TESTS = """Write pytest tests for these functions of `{path}`.

{functions}

Import them from `{module}`. Answer with one complete Python test file only."""


def _finding_line(with_suggestion: bool) -> Column:
    parts = [
        F.lit("  "), F.col("idx"), F.lit(". ["), F.upper("severity"), F.lit("] "), F.col("title"),
        F.lit(" (line "), F.coalesce(F.col("line").cast("string"), F.lit("None")), F.lit("): "),
        F.col("description"),
    ]
    if with_suggestion:
        parts += [F.lit("\n     Suggestion: "), F.col("suggestion")]
    return F.concat(*parts)


def _per_file(findings: DataFrame, files: DataFrame, with_suggestion: bool, limit: int | None) -> DataFrame:
    """(repo, path, content, findings): the findings of one file are few and are listed in order."""
    listed = (
        indexed(findings)
        .select("repo", F.col("key").alias("path"), "idx", _finding_line(with_suggestion).alias("line"))
        .groupBy("repo", "path")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("lines"))
        .select("repo", "path", F.array_join("lines.line", "\n").alias("findings"))
    )
    content = F.col("content") if limit is None else F.substring("content", 1, limit)
    return listed.join(
        files.filter(F.col("size") > 0).select("repo", "path", content.alias("content")), ["repo", "path"]
    )


def _filled(rows: DataFrame, template: str) -> DataFrame:
    names = {c: F.col(c) for c in rows.columns}
    return rows.select("repo", "path", text.fill(template, **names).alias("prompt"))


def validation_prompts(findings: DataFrame, files: DataFrame) -> DataFrame:
    return _filled(_per_file(findings, files, False, fv.VALIDATION_CONTEXT_CHARS), _VALIDATE)


def fix_prompts(fixes: DataFrame, files: DataFrame) -> DataFrame:
    return _filled(_per_file(fixes, files, True, None), _FIX)


def review_budget(files: DataFrame, salts: int | None = None) -> DataFrame:
    """Files that enter the review of their repo, in path order, within the total budget.

    Columns: repo, path, n_chars, snippet_chars, before (characters of earlier snippets), included. The
    first file that passes the budget is kept as "not included", later ones are dropped.

    Only paths and lengths are dealt, by ranges of (repo, path), so one repo uses as many tasks as there are
    ranges: ``salts`` of them, or the session's number of shuffle partitions.
    """
    n = F.length("content")
    over = F.lit(fv.REVIEW_SNIPPET_CHARS)
    note = F.length(F.concat(F.lit("\n# ... ["), (n - over).cast("string"),
                             F.lit(" more chars, file continues] ...")))
    sized = files.filter(~text.ends_with_any(F.col("path"), fv.REVIEW_SKIP_SUFFIXES)).select(
        "repo", "path", n.alias("n_chars"),
        F.when(n > over, over + note).otherwise(n).alias("snippet_chars"),
    )

    budget = fv.REVIEW_TOTAL_CHARS
    return within_budget(sized, ["repo"], ["path"], "snippet_chars", "before", budget, salts).withColumn(
        "included", F.col("before") + F.col("snippet_chars") <= budget
    )


def review_prompt_parts(files: DataFrame) -> DataFrame:
    """The review request of each repo as ordered parts (repo, part, path, text).

    Parts 0 and 2 are the fixed head and tail, part 1 has one row per file in path order. Joined with
    newlines they are the request; keeping rows avoids building one string from many files.
    """
    chosen = review_budget(files).join(files.select("repo", "path", "content"), ["repo", "path"])
    limit = fv.REVIEW_SNIPPET_CHARS
    snippet = F.when(
        F.col("n_chars") > limit,
        F.concat(F.substring("content", 1, limit), F.lit("\n# ... ["), F.col("n_chars") - limit,
                 F.lit(" more chars, file continues] ...")),
    ).otherwise(F.col("content"))
    body = F.when(
        F.col("included"), F.concat(F.lit("\n--- "), F.col("path"), F.lit(" ---\n"), snippet)
    ).otherwise(F.concat(F.lit("\n--- "), F.col("path"), F.lit(" (skipped, "), F.col("n_chars"), F.lit(" chars) ---")))
    parts = chosen.select("repo", F.lit(1).alias("part"), "path", body.alias("text"))
    ends = F.array(
        F.struct(F.lit(0).alias("part"), F.lit("").alias("path"), F.lit(_REVIEW_HEAD).alias("text")),
        F.struct(F.lit(2).alias("part"), F.lit("").alias("path"), F.lit(_REVIEW_TAIL).alias("text")),
    )
    repos = parts.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    return parts.unionByName(repos.select("repo", F.inline(ends)))


def test_prompts(functions: DataFrame) -> DataFrame:
    """One request per file from its public functions (bounded by the file's own size)."""
    head = F.concat(
        F.lit("### "), F.coalesce(F.concat("class", F.lit(".")), F.lit("")), F.col("name"),
        F.lit("() (line "), F.col("line"), F.lit(")\n```python\n"), F.col("source"), F.lit("\n```"),
    )
    listed = functions.groupBy("repo", "path").agg(
        F.array_sort(F.collect_list(F.struct("seq", head.alias("text")))).alias("f")
    )
    module = F.regexp_replace(F.translate("path", "/\\", ".."), r"\.py$", "")
    rows = listed.select("repo", "path", F.array_join("f.text", "\n\n").alias("functions"), module.alias("module"))
    return _filled(rows, _TESTS)
