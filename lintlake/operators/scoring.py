"""Scores, tags, recommendations, severity counts, rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions.memo import per_application
from lintlake.operators.repo_facts import mask_of, repo_facts
from lintlake.options import DEFAULTS, Options

STATIC_ANALYZERS = [row[0] for row in fv.ANALYZERS if row[0] != "AI Deep Review"]


def _chain(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return reduce(lambda acc, p: F.when(p[0], p[1]).otherwise(acc), reversed(pairs), otherwise)


def severity_rank(severity: Column) -> Column:
    return _chain(
        [(severity == s, F.lit(i)) for i, s in enumerate(fv.SEVERITIES)],
        F.lit(fv.UNKNOWN_SEVERITY_RANK),
    )


def severity_icon(severity: Column) -> Column:
    return _chain(
        [(severity == s, F.lit(icon)) for s, icon in fv.SEVERITY_ICONS.items()],
        F.lit(fv.UNKNOWN_SEVERITY_ICON),
    )


def points(analyzer: str, severity: Column) -> Column:
    """Deduction of one finding of the analyzer."""
    decimal = lambda v: F.lit(v).cast("decimal(3,1)")
    *by_severity, other = next(row[2:] for row in fv.ANALYZERS if row[0] == analyzer)
    return _chain(
        [(severity == s, decimal(v)) for s, v in zip(fv.SEVERITIES, by_severity)], decimal(other)
    )


@per_application
def _deductions() -> list[Column]:
    """One sum per analyzer."""
    return [
        F.sum(F.when(F.col("analyzer") == name, points(name, F.col("severity")))).alias(name)
        for name in STATIC_ANALYZERS
    ]


COUNTS = ["total", "critical", "high"]


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
    ]


def repos_of(files: DataFrame) -> DataFrame:
    """One row per repo with its number of files; reads no content."""
    return repo_facts(files, ["n_files"])


def wide_scores(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """One row per repo with one score column per analyzer, and the counts of findings; a clean analyzer scores 10.

    Findings are read once and reduced to one row per (task, repo) before the shuffle.
    """
    deductions = findings.groupBy("repo").agg(*_deductions(), *_counts())
    ten, one = F.lit(10).cast("decimal(6,1)"), F.lit(1).cast("decimal(6,1)")
    return repos.join(deductions, "repo", "left").select(
        *repos.columns,
        *[
            F.greatest(one, ten - F.coalesce(F.col(f"`{name}`"), F.lit(0)))
            .cast("decimal(6,1)").alias(name)
            for name in STATIC_ANALYZERS
        ],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS],
    )


def analyzer_scores(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, analyzer, score), all static analyzers for every repo."""
    entries = F.array(*[
        F.struct(F.lit(name).alias("analyzer"), F.col(f"`{name}`").alias("score"))
        for name in STATIC_ANALYZERS
    ])
    return wide_scores(findings, repos).select("repo", F.inline(entries))


def repo_scores(findings: DataFrame, repos: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Five category scores per repo, one decimal, HALF_UP."""
    return counted_scores(findings, repos, options).drop(*COUNTS)


def counted_scores(findings: DataFrame, repos: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """``repo_scores`` with the counts of findings."""
    one_decimal = lambda c: F.round(c, 1).cast("decimal(4,1)")
    # Weights may be columns of ``repos`` (``overrides.column_options``).
    weight = {k: F.lit(v).cast("decimal(4,2)") for k, v in options.weights.items()}
    base = wide_scores(findings, repos).select(
        *repos.columns, *COUNTS,
        one_decimal((F.col("Clarity") + F.col("Functionality")) / 2).alias("quality"),
        one_decimal((F.col("Structure") + F.col("Reusability")) / 2).alias("structure"),
        one_decimal(F.col("Security")).alias("security"),
        F.col("Automation").alias("automation"),
    )
    return base.withColumn(
        "usefulness", one_decimal((F.col("automation") + F.col("quality")) / 2)
    ).withColumn(
        "overall",
        one_decimal(sum((F.col(k) * w for k, w in weight.items()), F.lit(0).cast("decimal(4,1)"))),
    ).drop("automation")


# --- tags --------------------------------------------------------------------------------------

_KEYWORDS = [(tag, word) for tag, words in fv.TAG_KEYWORDS.items() for word in words]


@per_application
def _keyword_mask(text_column: Column) -> Column:
    lowered = F.lower(text_column)
    return mask_of([F.contains(lowered, F.lit(word)) for _, word in _KEYWORDS])


def tags(files: DataFrame, repo_path: Column | None = None) -> DataFrame:
    """Category of each repo.

    A file becomes one 64-bit mask of the keywords it contains and masks are OR-ed, so the aggregate
    has an 8-byte state. No keyword spans a line end, so this equals a search in all texts joined.
    """
    return tagged_repos(files, repo_path).select("repo", "tag")


def tagged_repos(files: DataFrame, repo_path: Column | None = None) -> DataFrame:
    """(repo, tag, n_files) in one pass over the files."""
    mask = files.groupBy("repo").agg(
        F.bit_or(_keyword_mask(F.col("content"))).alias("mask"), F.count(F.lit(1)).alias("n_files")
    )
    name = repo_path if repo_path is not None else F.col("repo")
    mask = mask.withColumn("mask", F.col("mask").bitwiseOR(_keyword_mask(name)))
    counts, first = [], 0
    for order, (tag, words) in enumerate(fv.TAG_KEYWORDS.items()):
        bits = ((1 << len(words)) - 1) << first
        first += len(words)
        counts.append(F.struct(
            F.bit_count(F.col("mask").bitwiseAND(F.lit(bits))).alias("n"),
            F.lit(-order).alias("order"),
            F.lit(tag).alias("tag"),
        ))
    best = F.array_max(F.array(*counts))
    return mask.select("repo", "n_files", best.alias("best")).select(
        "repo", "n_files", F.when(F.col("best.n") > 0, F.col("best.tag")).otherwise(fv.DEFAULT_TAG).alias("tag")
    )


def recommendation(overall: Column, n_files: Column) -> Column:
    return (
        F.when((overall >= 7.5) & (n_files > 3), "promote")
        .when(overall >= 4.5, "maintain")
        .when((overall >= 2.5) | (n_files <= 2), "maintain")
        .otherwise("archive")
    )


# --- counts and rankings -----------------------------------------------------------------------


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo").agg(*_counts())


def findings_by_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo", "file").agg(F.count(F.lit(1)).alias("n_findings"))


def top_findings(findings: DataFrame, k: int = 5) -> DataFrame:
    """First k findings per repo by severity, then emission order.

    The rank filter lets Spark cut every map task's rows to k per repo before the shuffle.
    """
    order = Window.partitionBy("repo").orderBy(severity_rank(F.col("severity")), "ord")
    return findings.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def scorecard(
    findings: DataFrame, files: DataFrame, options: Options = DEFAULTS
) -> DataFrame:
    """Scores, tag, recommendation, number of files and of findings per repo."""
    repos = tagged_repos(files)
    return counted_scores(findings, repos, options).withColumn(
        "recommendation", recommendation(F.col("overall"), F.col("n_files"))
    )


def portfolio(cards: DataFrame) -> DataFrame:
    """Portfolio rows; ``portfolio_order`` gives the ranking."""
    return cards.select(
        F.col("repo").alias("Repo"),
        F.col("overall").alias("Score"),
        F.col("tag").alias("Tag"),
        F.col("recommendation").alias("Recommendation"),
        F.col("total").alias("Findings"),
    )


def portfolio_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("Score"), "Repo")


def color_band(score: Column) -> Column:
    return F.when(score >= 7.5, "Green").when(score >= 5, "Yellow").otherwise("Red")
