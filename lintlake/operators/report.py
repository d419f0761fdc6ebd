"""The Markdown report as a table of lines.

A report is rows (repo, section, block, name, ord, part, line_no, line); sorted by these columns they
are the text. No repo is ever gathered into one string or one task: a large report is simply many
rows, and the sort is range-partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake import __version__
from lintlake import fixed_values as fv
from lintlake.functions import text
from lintlake.operators.findings import ORD_TYPE, union_all
from lintlake.operators.scoring import _chain, severity_icon, top_findings

HEADER, SUMMARY, TOP, BY_FILE, PLAN, PATCHES, TESTS, TREND, FOOTER = range(9)
ORDER = ["repo", "section", "block", "name", "ord", "part", "line_no"]


def describe(files: DataFrame) -> DataFrame:
    """What each repo is about: first usable README paragraph, else first module docstring.

    Candidates are reduced by a partial ``min_by``; one short text per task and repo is shuffled.
    """
    path, content = F.col("path"), F.col("content")
    paragraphs = F.transform(
        F.split(content, "\n\n", -1),
        lambda p: text.strip(F.ltrim(text.strip(p), F.lit("# "))),
    )
    usable = F.get(
        F.filter(
            paragraphs,
            lambda p: (p != "") & ~text.starts_with_any(p, fv.README_SKIP_STARTS),
        ),
        F.lit(0),
    )
    closing = F.locate('"""', content, 4)
    docstring = F.when(
        content.startswith('"""') & (closing > 0),
        text.strip(F.substr(content, F.lit(4), closing - F.lit(4))),
    )
    readme_rank = _chain([(path == n, F.lit(i)) for i, n in enumerate(fv.README_NAMES)], F.lit(None))
    candidate = F.when(readme_rank.isNotNull(), usable)
    rank = F.when(candidate.isNotNull(), readme_rank).otherwise(F.lit(len(fv.README_NAMES)))
    value = F.substring(F.coalesce(candidate, docstring), 1, fv.DESCRIPTION_LENGTH)
    return files.select("repo", "path", rank.alias("rank"), value.alias("value")).groupBy("repo").agg(
        F.coalesce(
            F.min_by("value", F.when(F.col("value").isNotNull(), F.struct("rank", "path"))),
            F.lit(fv.NO_DESCRIPTION),
        ).alias("description")
    )


# --- single rows ------------------------------------------------------------------------------


def line_suffix(line: Column) -> Column:
    return F.when(F.coalesce(line, F.lit(0)) != 0, F.concat(F.lit(" (line "), line, F.lit(")"))).otherwise("")


def top_entry() -> Column:
    """Lines of one ranked finding."""
    none = F.array().cast("array<string>")
    fenced = lambda label, c: F.when(
        F.coalesce(c, F.lit("")) != "",
        F.concat(F.array(F.lit(""), F.lit("```"), F.lit(f"# {label}:")), F.split(c, "\n", -1), F.array(F.lit("```"))),
    ).otherwise(none)
    return F.concat(
        F.array(
            F.concat(F.lit("### "), F.col("rank"), F.lit(". "), severity_icon(F.col("severity")),
                     F.lit(" ["), F.upper("severity"), F.lit("] "), F.col("title")),
            F.concat(F.lit("**File:** `"), F.col("file"), F.lit("`")),
        ),
        F.when(F.coalesce("line", F.lit(0)) != 0, F.array(F.concat(F.lit("**Line:** "), F.col("line"))))
        .otherwise(none),
        F.array(F.lit(""), F.col("description"), F.lit(""),
                F.concat(F.lit("**Suggestion:** "), F.col("suggestion"))),
        fenced("Before", F.col("code_before")),
        fenced("After", F.col("code_after")),
        F.array(F.lit("")),
    )


def file_entry() -> Column:
    return F.concat(
        F.lit("- "), severity_icon(F.col("severity")), F.lit(" **"), F.col("title"), F.lit("**"),
        line_suffix(F.col("line")), F.lit(": "), F.col("suggestion"),
    )


def plan_rows(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Next-iteration entries (repo, priority, ord, entry); 4 = what can be automated."""
    dashed = lambda *parts: F.concat(F.lit("- [ ] "), *parts)
    suggestion = F.col("suggestion")
    urgent = findings.filter(F.col("severity").isin("critical", "high")).select(
        "repo", F.lit(1).alias("priority"), "ord",
        dashed(F.lit("**"), F.col("title"), F.lit("** in `"), F.col("file"), F.lit("` — "), suggestion)
        .alias("entry"),
    )
    of = lambda category, n: findings.filter(F.col("category") == category).select(
        "repo", F.lit(n).alias("priority"), "ord", dashed(suggestion).alias("entry")
    )
    automation = of("automation", 3)

    def fixed(rows: DataFrame, n: int, entries: list[str]) -> DataFrame:
        order = lambda i: F.struct(
            F.lit(0).alias("analyzer"), F.lit(0).alias("phase"), F.lit("").alias("path"),
            F.lit(0).alias("check"), F.lit(i).alias("sub"))
        array = F.array(*[F.struct(order(i).alias("ord"), F.lit(e).alias("entry")) for i, e in enumerate(entries)])
        return rows.select("repo", F.lit(n).alias("priority"), F.inline(array))

    without = repos.select("repo").join(automation.select("repo").distinct(), "repo", "left_anti")
    return union_all([
        urgent,
        of("structure", 2),
        automation,
        fixed(without, 3, [f"- [ ] {s}" for s in fv.DEFAULT_AUTOMATION_STEPS]),
        fixed(repos, 4, [f"- {s}" for s in fv.AUTOMATABLE_STEPS]),
    ])


def prefixed_notes(notes: DataFrame) -> DataFrame:
    return notes.select(
        "repo", "analyzer", "path", "sub",
        F.concat(F.lit("- ["), F.col("analyzer"), F.lit("] "), F.col("note")).alias("entry"),
    )


# --- sections ---------------------------------------------------------------------------------


def _rows(df: DataFrame, section: int, lines: Column, block: Column | int = 0, name: Column | str = "",
          ord_: Column | None = None, part: int = 0) -> DataFrame:
    as_col = lambda v: F.lit(v) if isinstance(v, (int, str)) else v
    return df.select(
        "repo", F.lit(section).alias("section"), as_col(block).alias("block"), as_col(name).alias("name"),
        (ord_ if ord_ is not None else F.lit(None).cast(ORD_TYPE)).alias("ord"),
        F.lit(part).alias("part"), F.posexplode_outer(lines).alias("line_no", "line"),
    )


def _lines(*parts: Column | str) -> Column:
    return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _text(template: str, *names: str) -> Column:
    return text.fill(template, **{n: F.col(n) for n in names})


def header_rows(cards: DataFrame, generated: str, smart: bool) -> DataFrame:
    version = "2.0.0 (Smart)" if smart else __version__
    lines = _lines(
        F.concat(F.lit("# Quality Report: "), text.basename(F.col("repo"))), "",
        f"**Generated:** {generated}", f"**Version:** {version}",
    )
    return _rows(cards, HEADER, lines)


def summary_rows(cards: DataFrame, descriptions: DataFrame) -> DataFrame:
    label = _chain([(F.col("recommendation") == k, F.lit(v)) for k, v in fv.RECOMMENDATION_LABELS.items()],
                   F.col("recommendation"))
    lines = _lines(
        "## Summary", "",
        _text("**What this app does:** {description}", "description"), "",
        _text("**Files analyzed:** {n_files}", "n_files"),
        _text("**Total findings:** {total} ({critical} critical, {high} high)", "total", "critical", "high"), "",
        "### Scores (1-10)", "",
        "| Category   | Score |", "|------------|-------|",
        _text("| Quality    | {quality} |", "quality"),
        _text("| Structure  | {structure} |", "structure"),
        _text("| Security   | {security} |", "security"),
        _text("| Usefulness | {usefulness} |", "usefulness"),
        _text("| **Overall**| **{overall}** |", "overall"), "",
        _text("**Tag:** `{tag}`", "tag"),
        F.concat(F.lit("**Recommendation:** "), label),
    )
    return _rows(cards.join(descriptions, "repo"), SUMMARY, lines)


def top_rows(findings: DataFrame, cards: DataFrame) -> DataFrame:
    head = F.when(F.col("total") > 0, _lines("## Top 5 Highest-Impact Improvements", "")).otherwise(
        _lines("## Top 5 Improvements", "", "No significant issues found.")
    )
    return _rows(cards, TOP, head).unionByName(
        _rows(top_findings(findings), TOP, top_entry(), block=F.col("rank"))
    )


def file_rows(findings: DataFrame, notes: DataFrame, cards: DataFrame) -> DataFrame:
    head = F.when(F.col("total") > 0, _lines("## File-by-File Analysis", "")).otherwise(
        _lines("## File-by-File Analysis", "", "All files look clean.")
    )
    per_file = findings.groupBy("repo", "file").agg(F.count(F.lit(1)).alias("n"))
    file = F.col("file")
    entries = prefixed_notes(notes).join(
        cards.filter(F.col("total") > 0).select("repo"), "repo", "left_semi"
    )
    noted = entries.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    analyzer_no = _chain(
        [(F.col("analyzer") == row[0], F.lit(i)) for i, row in enumerate(fv.ANALYZERS)], F.lit(99)
    )
    note_ord = F.struct(
        analyzer_no.alias("analyzer"), F.lit(0).alias("phase"), F.col("path"), F.lit(0).alias("check"),
        F.col("sub").cast("int").alias("sub"),
    )
    return union_all([
        _rows(cards, BY_FILE, head),
        _rows(per_file, BY_FILE, _lines(_text("### `{file}`", "file"), _text("*{n} finding(s)*", "n"), ""),
              1, file),
        _rows(findings, BY_FILE, _lines(file_entry()), 1, file, F.col("ord"), 1),
        _rows(per_file, BY_FILE, _lines(""), 1, file, _last_ord(), 2),
        _rows(noted, BY_FILE, _lines("### Additional Notes", ""), 2),
        _rows(entries, BY_FILE, _lines(F.col("entry")), 2, "", note_ord, 1),
        _rows(noted, BY_FILE, _lines(""), 2, "", _last_ord(), 2),
    ])


def _last_ord() -> Column:
    """Sorts behind every finding."""
    return F.struct(
        F.lit(1000).alias("analyzer"), F.lit(0).alias("phase"), F.lit("").alias("path"),
        F.lit(0).alias("check"), F.lit(0).alias("sub"))


_PLAN_TITLES = {
    1: "### Priority 1: Fix Critical Issues",
    2: "### Priority 2: Improve Structure",
    3: "### Priority 3: Add Automation",
    4: "### Automatable Improvements",
}


def plan_section(findings: DataFrame, cards: DataFrame) -> DataFrame:
    entries = plan_rows(findings, cards)
    used = entries.groupBy("repo", "priority").agg(F.count(F.lit(1)).alias("n"))
    priority = F.col("priority")
    title = _chain([(priority == n, F.lit(t)) for n, t in _PLAN_TITLES.items()], F.lit(""))
    return union_all([
        _rows(cards, PLAN, _lines("## Next Iteration Plan", "")),
        _rows(used, PLAN, _lines(title), priority),
        _rows(entries, PLAN, _lines(F.col("entry")), priority, "", F.col("ord"), 1),
        _rows(used.filter(priority < 4), PLAN, _lines(""), priority, "", _last_ord(), 2),
    ])


def footer_rows(cards: DataFrame) -> DataFrame:
    return _rows(cards, FOOTER, _lines(
        "---", "", f"*Generated by lintlake v{__version__}*",
        "*One row set per repository; later runs are compared with this one.*",
    ))


def spliced_rows(lines: DataFrame, section: int) -> DataFrame:
    """Optional section from (repo, block, name, line_no, line) rows."""
    return lines.select(
        "repo", F.lit(section).alias("section"), "block", "name",
        F.lit(None).cast(ORD_TYPE).alias("ord"), F.lit(0).alias("part"), "line_no", "line",
    )


def _gaps(cards: DataFrame, extra: dict[int, DataFrame]) -> DataFrame:
    """Blank lines in front of sections: two before a spliced one, else one."""

    def before(repos: DataFrame, section: int, n: int) -> DataFrame:
        return _rows(repos, section, _lines(*[""] * n), -1)

    return union_all([
        *[before(cards, section, 1) for section in (SUMMARY, TOP, BY_FILE, PLAN, FOOTER)],
        *[before(lines.select("repo").distinct(), section, 2) for section, lines in extra.items()],
    ])


def report_lines(
    findings: DataFrame,
    cards: DataFrame,
    descriptions: DataFrame,
    notes: DataFrame,
    generated: str,
    smart: bool = False,
    extra: dict[int, DataFrame] | None = None,
) -> DataFrame:
    """All lines of all reports. ``extra`` maps PATCHES / TESTS / TREND to their section lines."""
    body = union_all([
        header_rows(cards, generated, smart),
        summary_rows(cards, descriptions),
        top_rows(findings, cards),
        file_rows(findings, notes, cards),
        plan_section(findings, cards),
        footer_rows(cards),
        *[spliced_rows(lines, section) for section, lines in (extra or {}).items()],
    ])
    # Which sections a repo has is known from the rows that always exist.
    return body.unionByName(_gaps(cards, extra or {}))


def in_order(lines: DataFrame) -> DataFrame:
    """Global range sort; large repos spread over several partitions."""
    return lines.orderBy(*ORDER)
