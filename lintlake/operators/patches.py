"""Patches proposed by answers: selection, application to the files table, report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions import text
from lintlake.functions.ranking import numbered
from lintlake.operators.answers import FIXES, indexed, parsed
from lintlake.operators.scoring import _chain


def fixable(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of at least medium severity that name exactly one existing file."""
    return findings.filter(
        F.col("severity").isin("critical", "high", "medium") & ~F.col("file").contains(",")
    ).join(files.select("repo", F.col("path").alias("file")), ["repo", "file"], "left_semi")


def proposed(fixes: DataFrame, files: DataFrame, responses: DataFrame) -> DataFrame:
    """``responses(repo, key, text)`` -> patches whose original text occurs in the file.

    The title is that of the finding with the answer's 1-based index among the file's fixable
    findings, or ``Fix``.
    """
    rows = responses.select(
        "repo", "key", F.posexplode_outer(parsed(F.col("text"), FIXES)).alias("seq", "a")
    ).filter(F.col("a").isNotNull()).select(
        "repo", F.col("key").alias("path"), "seq",
        F.coalesce("a.finding_index", F.lit(1)).alias("idx"),
        F.coalesce("a.original", F.lit("")).alias("original"),
        F.coalesce("a.fixed", F.lit("")).alias("fixed"),
        F.coalesce("a.explanation", F.lit("")).alias("explanation"),
    ).filter(F.col("original") != "")
    # Only files that have fixable findings were asked about. One row per file, so the findings are worked out once.
    asked = indexed(fixes).groupBy("repo", F.col("key").alias("path")).agg(
        F.map_from_entries(F.collect_list(F.struct("idx", "title"))).alias("titles")
    )
    return (
        rows.join(asked, ["repo", "path"])
        .join(files.select("repo", "path", "content"), ["repo", "path"])
        .filter(F.contains("content", "original"))
        .select("repo", "path", "seq", F.coalesce(F.try_element_at("titles", F.col("idx")), F.lit("Fix")).alias("finding"),
                "original", "fixed", "explanation")
    )


def _sequence(patches: DataFrame) -> DataFrame:
    """Patches of one file as an ordered array; bounded by the length of one answer."""
    entry = F.struct("seq", "finding", "original", "fixed", "explanation")
    return patches.groupBy("repo", "path").agg(F.array_sort(F.collect_list(entry)).alias("patches"))


def _applied(content: Column) -> Column:
    """Fold the patches over the text; each sees the result of the ones before."""
    start = F.struct(content.alias("content"), F.array().cast("array<boolean>").alias("done"))

    def step(acc: Column, p: Column) -> Column:
        once = text.count_of(acc["content"], p["original"]) == 1
        return F.struct(
            F.when(once, F.replace(acc["content"], p["original"], p["fixed"]))
            .otherwise(acc["content"]).alias("content"),
            F.concat(acc["done"], F.array(once)).alias("done"),
        )

    return F.aggregate(F.col("patches"), start, step)


def apply_patches(patches: DataFrame, files: DataFrame, dry_run: bool = True) -> DataFrame:
    """Patches that apply (their text occurs exactly once), with a status."""
    joined = _sequence(patches).join(files.select("repo", "path", "content"), ["repo", "path"])
    if dry_run:
        fits = lambda p, i: text.count_of(F.col("content"), p["original"]) == 1
        status = "would_apply"
    else:
        joined = joined.withColumn("result", _applied(F.col("content")))
        fits = lambda p, i: F.get(F.col("result.done"), i)
        status = "applied"
    flagged = F.transform(F.col("patches"), lambda p, i: F.struct(p.alias("p"), fits(p, i).alias("fits")))
    return (
        text.inline_rows(joined, ["repo", "path"], flagged)
        .filter("fits")
        .select("repo", "path", "p.seq", "p.finding", "p.original", "p.fixed", "p.explanation",
                F.lit(status).alias("status"))
    )


def patched_files(patches: DataFrame, files: DataFrame) -> DataFrame:
    """The files table after applying the patches; the input table is not touched."""
    joined = files.join(_sequence(patches), ["repo", "path"], "left")
    content = F.when(F.col("patches").isNull(), F.col("content")).otherwise(
        _applied(F.col("content"))["content"]
    )
    return joined.select("repo", "path", content.alias("content")).withColumn(
        "size", F.octet_length("content").cast("long")
    )


def patch_lines(patches: DataFrame) -> DataFrame:
    """Report rows: (repo, number, line_no, line). Numbers run over the whole repo."""
    status = _chain(
        [(F.col("status") == s, F.lit(label)) for s, label in fv.PATCH_STATUS_LABELS.items()], F.lit("?")
    )
    signed = lambda c, sign: F.transform(F.split(c, "\n", -1), lambda l: F.concat(F.lit(sign), l))
    lines = F.concat(
        F.array(
            F.concat(F.lit("### Patch "), F.col("number"), F.lit(": "), F.col("finding")),
            F.concat(F.lit("**File:** `"), F.col("path"), F.lit("` | **Status:** "), status),
            F.lit(""),
            F.col("explanation"),
            F.lit(""),
            F.lit("```diff"),
        ),
        signed(F.col("original"), "- "),
        signed(F.col("fixed"), "+ "),
        F.array(F.lit("```"), F.lit("")),
    )
    return numbered(patches, ["repo"], ["path", "seq"], "number").select(
        "repo", "number", F.posexplode_outer(lines).alias("line_no", "line")
    )


def patch_totals(patches: DataFrame) -> DataFrame:
    return patches.groupBy("repo").agg(F.count(F.lit(1)).alias("n_patches"))


def patch_section(patches: DataFrame, repos: DataFrame) -> DataFrame:
    """The report's patches section (repo, block, name, line_no, line) for every repo of ``repos``.

    Block 0 is the head, block n the n-th patch of the repo; a repo without patches says so.
    """
    none = F.array(F.lit(fv.PATCHES_TITLE), F.lit(""), F.lit(fv.NO_PATCHES))
    some = F.array(
        F.lit(fv.PATCHES_TITLE), F.lit(""), text.fill(fv.PATCHES_TOTAL, n=F.col("n_patches")), F.lit("")
    )
    heads = repos.select("repo").join(patch_totals(patches), "repo", "left")
    head = heads.select(
        "repo", F.lit(0).alias("block"),
        F.posexplode_outer(F.when(F.col("n_patches") > 0, some).otherwise(none)).alias("line_no", "line"),
    )
    body = patch_lines(patches).join(repos.select("repo"), "repo", "left_semi")
    body = body.select("repo", F.col("number").cast("int").alias("block"), "line_no", "line")
    return head.unionByName(body).select("repo", "block", F.lit("").alias("name"), "line_no", "line")
