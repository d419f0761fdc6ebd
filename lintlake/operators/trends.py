"""Run history: comparison with the previous run, regressions, best and worst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake import fixed_values as fv

_SCORES = fv.SCORE_CATEGORIES


def with_previous(runs: DataFrame, bucket: str = "day") -> DataFrame:
    """Add ``prev``: the scores of the run before, null for the first run of a repo.

    A plain lag over all runs of a repo would put a repo with very long history into one task.
    Runs are cut into time buckets instead: lag inside (repo, bucket), and for the first run of a
    bucket the last run of the bucket before it, taken from a small per-bucket summary.
    """
    order = F.struct("run_ts", "run_id")
    scores = F.struct(*_SCORES)
    runs = runs.withColumn("bucket", F.date_trunc(bucket, "run_ts"))
    last = runs.groupBy("repo", "bucket").agg(F.max_by(scores, order).alias("last"))
    carried = last.select(
        "repo", "bucket",
        F.lag("last").over(Window.partitionBy("repo").orderBy("bucket")).alias("carried"),
    )
    inside = Window.partitionBy("repo", "bucket").orderBy("run_ts", "run_id")
    return (
        runs.withColumn("inside", F.lag(scores).over(inside))
        .join(carried, ["repo", "bucket"])
        .withColumn("prev", F.coalesce("inside", "carried"))
        .drop("bucket", "inside", "carried")
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each repo."""
    row = F.struct(*runs.columns)
    return (
        runs.groupBy("repo")
        .agg(F.max_by(row, F.struct("run_ts", "run_id")).alias("r"))
        .select("r.*")
    )


def newest(runs: DataFrame, k: int) -> DataFrame:
    """The last ``k`` runs of each repo; Spark cuts every task's rows to ``k`` per repo before the shuffle."""
    order = Window.partitionBy("repo").orderBy(F.desc("run_ts"), F.desc("run_id"))
    return runs.withColumn("back", F.row_number().over(order)).filter(F.col("back") <= k).drop("back")


def trend_rows(runs: DataFrame, latest_only: bool = False) -> DataFrame:
    """Five rows per run that has a previous one: previous, current, delta, arrow, regression."""
    compared = latest_runs(with_previous(newest(runs, 2))) if latest_only else with_previous(runs)
    entries = F.array(*[
        F.struct(
            F.lit(i).alias("category_no"),
            F.lit(c).alias("category"),
            F.col(f"prev.{c}").alias("previous"),
            F.col(c).alias("current"),
        )
        for i, c in enumerate(_SCORES)
    ])
    delta = (F.col("current") - F.col("previous")).cast("decimal(4,1)")
    return (
        compared.filter(F.col("prev").isNotNull())
        .select("repo", "run_ts", "run_id", F.inline(entries))
        .withColumn("delta", delta)
        .withColumn("arrow", F.when(delta > 0, "↑").when(delta < 0, "↓").otherwise("→"))
        .withColumn("regression", delta < 0)
    )


def history_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("repo").agg(
        F.count(F.lit(1)).alias("runs_tracked"),
        F.max("overall").alias("best"),
        F.min("overall").alias("worst"),
    )


def _label(category: Column) -> Column:
    return F.when(category == "overall", "**Overall**").otherwise(F.initcap(category))


def trend_section(runs: DataFrame) -> DataFrame:
    """Report lines of the newest run: (repo, block, line_no, line)."""
    latest = latest_runs(with_previous(newest(runs, 2))).join(history_summary(runs), "repo")

    def per_category(make) -> list[Column]:
        return [make(c, F.col(f"prev.{c}"), F.col(c), (F.col(c) - F.col(f"prev.{c}")).cast("decimal(4,1)"))
                for c in _SCORES]

    def table_row(c: str, prev: Column, cur: Column, delta: Column) -> Column:
        change = (
            F.when(delta > 0, F.concat(F.lit("↑ +"), delta))
            .when(delta < 0, F.concat(F.lit("↓ "), delta))
            .otherwise("→ 0.0")
        )
        label = "**Overall**" if c == "overall" else c.capitalize()
        return F.concat(F.lit(f"| {label} | "), prev, F.lit(" | "), cur, F.lit(" | "), change, F.lit(" |"))

    def warning(c: str, prev: Column, cur: Column, delta: Column) -> Column:
        line = F.concat(F.lit(f"- **{c.capitalize()}** dropped from "), prev, F.lit(" to "), cur,
                        F.lit(" ("), delta, F.lit(")"))
        return F.when(delta < 0, line)

    warnings = F.array_compact(F.array(*per_category(warning)))
    lines = F.concat(
        F.array(
            F.lit("## Trend Tracking"), F.lit(""),
            F.concat(F.lit("**Runs tracked:** "), F.col("runs_tracked")), F.lit(""),
            F.lit("### Current vs Previous"), F.lit(""),
            F.lit("| Category   | Previous | Current | Change |"),
            F.lit("|------------|----------|---------|--------|"),
            *per_category(table_row),
            F.lit(""),
            F.concat(F.lit("**Best overall score:** "), F.col("best"), F.lit("  ")),
            F.concat(F.lit("**Worst overall score:** "), F.col("worst")),
            F.lit(""),
        ),
        F.when(
            F.size(warnings) > 0,
            F.concat(F.array(F.lit("### Regression Warnings"), F.lit("")), warnings, F.array(F.lit(""))),
        ).otherwise(F.array().cast("array<string>")),
    )
    first_run = F.array(
        F.lit("## Trend Tracking"), F.lit(""),
        F.lit("First run — no trend data available yet. Scores from this run will be used as the "
              "baseline for future comparisons."),
    )
    shown = F.when(F.col("prev").isNull(), first_run).otherwise(lines)
    return latest.select("repo", F.posexplode_outer(shown).alias("line_no", "line"))
