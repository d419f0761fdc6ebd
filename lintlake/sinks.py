"""Writers. Every sink takes the rows as they are; none gathers a repo into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators.report import ORDER
from lintlake.sources.history import run_document


def metadata(
    cards: DataFrame, analyzer_scores: DataFrame, smart: bool = False, auto_fix: bool = False,
    fixes_applied: bool = False,
) -> DataFrame:
    """One row per repo in the metadata shape (nested scores, map of analyzer scores)."""
    by_analyzer = analyzer_scores.groupBy("repo").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("analyzer", "score")))).alias("analyzer_scores")
    )
    return cards.join(by_analyzer, "repo").select(
        F.col("repo").alias("repo_path"),
        F.col("n_files").alias("files_analyzed"),
        F.col("total").alias("total_findings"),
        F.struct("quality", "structure", "security", "usefulness", "overall").alias("scores"),
        "tag", "recommendation", "analyzer_scores",
        F.lit("smart" if smart else "static").alias("mode"),
        F.lit(auto_fix).alias("auto_fix"),
        F.lit(fixes_applied).alias("fixes_applied"),
    )


def write_metadata(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_portfolio(rows: DataFrame, path: str) -> None:
    """Ranked CSV; part files are in rank order."""
    rows.orderBy(F.desc("Score"), "Repo").write.mode("overwrite").csv(path, header=True)


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines of all repos as one table (repo, section order, line), range-partitioned in line order.

    The number of files follows the data, not the number of repos; ``export_report`` writes one repo's text.
    """
    ordered = lines.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    ordered.write.mode("overwrite").parquet(path)


def export_report(spark: SparkSession, path: str, repo: str, target: str) -> None:
    """The report of one repo as text; part files are in line order."""
    lines = spark.read.parquet(path).filter(F.col("repo") == repo)
    lines.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("line").write.mode("overwrite").text(target)


def append_run(runs: DataFrame, path: str, batch: str) -> None:
    """Add runs under a batch name; writing the same batch again replaces it, so a retry adds nothing twice."""
    runs.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def write_history(runs: DataFrame, path: str, batch: str) -> None:
    """History documents as rows (repo, document), a batch at a time like ``append_run``."""
    run_document(runs).select("repo", "run_ts", "document").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def write_session(projects: DataFrame, summary: DataFrame, timestamp: str, path: str) -> None:
    """Projects as JSON rows next to a one-row summary."""
    projects.withColumn("timestamp", F.lit(timestamp)).write.mode("overwrite").json(f"{path}/projects")
    summary.withColumn("timestamp", F.lit(timestamp)).write.mode("overwrite").json(f"{path}/summary")


def write_files(files: DataFrame, path: str) -> None:
    """A files table (patched or generated) to a new location; the input is never changed in place."""
    files.write.mode("errorifexists").parquet(path)


def write_bucketed_files(files: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """A files table in buckets of (repo, path), sorted, under ``path``; gives the table back.

    Texts are dealt once, while it is written: joins and groupings by (repo, path) then move the other side
    only. For that ``buckets`` has to be at least the session's number of shuffle partitions.
    """
    dealt = files.repartition(buckets, "repo", "path")
    dealt.write.bucketBy(buckets, "repo", "path").sortBy("repo", "path").option("path", path).saveAsTable(table)
    return files.sparkSession.table(table)


def generated_test_files(tests: DataFrame) -> DataFrame:
    size: Column = F.octet_length("code").cast("long")
    return tests.select("repo", F.col("test_path").alias("path"), F.col("code").alias("content"), size.alias("size"))
