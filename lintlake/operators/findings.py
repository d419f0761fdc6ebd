"""The findings table: schema, construction helpers and the single-pass file-check runner.

File-scope checks are column expressions ``-> array<finding>`` over ``path``, ``content`` and ``ln`` (the
array of numbered lines). All of them run in one projection over one scan, followed by one
``explode``: no shuffle, nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions import text
from lintlake.functions.memo import per_application
from lintlake.options import DEFAULTS, Options

ANALYZER_NO = {row[0]: i for i, row in enumerate(fv.ANALYZERS)}
CATEGORY = {row[0]: row[1] for row in fv.ANALYZERS}

_ITEM = ("struct<line:int,severity:string,title:string,description:string,"
         "suggestion:string,code_before:string>")

ORD_TYPE = "struct<analyzer:int,phase:int,path:string,check:int,sub:int>"
FINDINGS_SCHEMA = (
    "repo string, analyzer string, category string, check_id string, file string, severity string, "
    "title string, description string, suggestion string, line int, code_before string, "
    f"code_after string, ord {ORD_TYPE}"
)


@dataclass(frozen=True)
class FileCheck:
    """A check that looks at one file at a time."""

    check_id: str
    analyzer: str
    phase: int
    order: int
    expression: Callable[[Options], Column]


def with_lines(files: DataFrame) -> DataFrame:
    """Add ``ln``: array of (no, raw, txt) with 1-based numbers and stripped text."""
    return files.withColumn(
        "ln",
        F.transform(
            text.split_lines(F.col("content")),
            lambda raw, i: F.struct(
                (i + F.lit(1)).alias("no"), raw.alias("raw"), text.strip(raw).alias("txt")
            ),
        ),
    )


def exploded_lines(files: DataFrame) -> DataFrame:
    """One row per line."""
    return files.select(
        "repo", "path", F.posexplode_outer(text.split_lines(F.col("content"))).alias("pos", "text")
    ).select("repo", "path", (F.col("pos") + 1).alias("line_no"), "text")


def next_text_line(x: Column, within: int) -> Column:
    """First non-blank of the ``within`` lines after line ``x`` (null if there is none)."""
    following = F.slice(F.col("ln"), x["no"] + F.lit(1), F.lit(within))
    return F.get(F.filter(following, lambda y: y["txt"] != ""), F.lit(0))


def item(
    message: str,
    line: Column | None = None,
    severity: Column | None = None,
    title: Column | None = None,
    code_before: Column | None = None,
    **values: Column,
) -> Column:
    """One finding from the message table."""
    fixed_severity, title_text, description, suggestion = fv.MESSAGES[message]
    if line is not None:
        values["line"] = line
    return F.struct(
        (line if line is not None else F.lit(None)).cast("int").alias("line"),
        (severity if severity is not None else F.lit(fixed_severity)).alias("severity"),
        (title if title is not None else text.fill(title_text, **values)).alias("title"),
        text.fill(description, **values).alias("description"),
        text.fill(suggestion, **values).alias("suggestion"),
        (code_before if code_before is not None else F.lit(None)).cast("string").alias("code_before"),
    )


def empty() -> Column:
    return F.array().cast(f"array<{_ITEM}>")


def gated(condition: Column, items: Column) -> Column:
    """Skip the costly expression where a cheap test on the whole text already excludes a hit."""
    return F.when(condition, items).otherwise(empty())


def at_most_one(condition: Column, one: Column) -> Column:
    return F.when(condition, F.array(one)).otherwise(empty())


@per_application
def _tagged(check: FileCheck, options: Options) -> Column:
    """The check's findings with its name and order key."""
    return F.transform(
        check.expression(options),
        lambda f, i: F.struct(
            F.lit(check.analyzer).alias("analyzer"),
            F.lit(CATEGORY[check.analyzer]).alias("category"),
            F.lit(check.check_id).alias("check_id"),
            f.alias("f"),
            F.struct(
                F.lit(ANALYZER_NO[check.analyzer]).alias("analyzer"),
                F.lit(check.phase).alias("phase"),
                F.col("path").alias("path"),
                F.lit(check.order).alias("check"),
                i.alias("sub"),
            ).alias("ord"),
        ),
    )


def file_findings(
    files: DataFrame, checks: Sequence[FileCheck], options: Options = DEFAULTS
) -> DataFrame:
    """Run file checks in one pass; ``opt_`` columns of the files are there for options that are columns."""
    settings = [c for c in files.columns if c.startswith("opt_")]
    arrays = [_tagged(c, options) for c in checks]
    found = text.explode_rows(
        with_lines(files.select("repo", "path", "content", *settings)), ["repo", "path"], F.concat(*arrays), "x"
    )
    return found.select(
        "repo",
        "x.analyzer",
        "x.category",
        "x.check_id",
        F.col("path").alias("file"),
        "x.f.severity",
        "x.f.title",
        "x.f.description",
        "x.f.suggestion",
        "x.f.line",
        "x.f.code_before",
        F.lit(None).cast("string").alias("code_after"),
        "x.ord",
    )


def finding_rows(
    rows: DataFrame,
    check_id: str,
    analyzer: str,
    phase: int,
    file: Column,
    found: Column,
    ord_path: Column | None = None,
    sub: Column | None = None,
) -> DataFrame:
    """Findings of a check whose rows are already one per finding."""
    f = found
    return rows.select(
        "repo",
        F.lit(analyzer).alias("analyzer"),
        F.lit(CATEGORY[analyzer]).alias("category"),
        F.lit(check_id).alias("check_id"),
        file.alias("file"),
        f["severity"].alias("severity"),
        f["title"].alias("title"),
        f["description"].alias("description"),
        f["suggestion"].alias("suggestion"),
        f["line"].alias("line"),
        f["code_before"].alias("code_before"),
        F.lit(None).cast("string").alias("code_after"),
        F.struct(
            F.lit(ANALYZER_NO[analyzer]).alias("analyzer"),
            F.lit(phase).alias("phase"),
            (ord_path if ord_path is not None else F.lit("")).alias("path"),
            F.lit(0).alias("check"),
            (sub if sub is not None else F.lit(0)).cast("int").alias("sub"),
        ).alias("ord"),
    )


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name; duplicates stay."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
