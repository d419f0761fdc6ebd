"""Run history files: one JSON document per repo with a ``runs`` list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_TYPE = (
    "struct<timestamp:string,"
    "scores:struct<quality:double,structure:double,security:double,usefulness:double,overall:double>,"
    "findings_count:bigint,files_analyzed:bigint,mode:string>"
)
HISTORY_SCHEMA = f"struct<runs:array<{RUN_TYPE}>>"


def parse_history(documents: DataFrame) -> DataFrame:
    """(repo, document) -> one row per run. Missing, broken or run-less documents give no rows."""
    parsed = F.from_json("document", HISTORY_SCHEMA)["runs"]
    score = lambda c: F.col(f"run.scores.{c}").cast("decimal(4,1)").alias(c)
    return (
        documents.select("repo", F.posexplode(parsed).alias("pos", "run"))
        .filter(F.col("run").isNotNull())
        .select(
            "repo",
            F.col("run.timestamp").cast("timestamp").alias("run_ts"),
            F.col("pos").cast("long").alias("run_id"),
            score("quality"), score("structure"), score("security"), score("usefulness"), score("overall"),
            "run.findings_count", "run.files_analyzed", "run.mode",
        )
    )


def read_history(spark: SparkSession, path: str, repo: Column) -> DataFrame:
    """Read whole history documents; ``repo`` is an expression over ``file`` (the document's path)."""
    documents = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("document"), F.col("_metadata.file_path").alias("file")
    )
    return parse_history(documents.select(repo.alias("repo"), "document"))


def run_document(runs: DataFrame) -> DataFrame:
    """One JSON line per run in the history format."""
    run = F.struct(
        F.date_format("run_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.struct("quality", "structure", "security", "usefulness", "overall").alias("scores"),
        "findings_count", "files_analyzed", "mode",
    )
    return runs.select("repo", "run_ts", "run_id", F.to_json(run).alias("document"))


def new_run(cards: DataFrame, run_ts: Column, run_id: Column, mode: str = "static") -> DataFrame:
    """Scorecards -> history rows; absent scores become 0.0."""
    zero = F.lit(0).cast("decimal(4,1)")
    scores = ["quality", "structure", "security", "usefulness", "overall"]
    return cards.select(
        "repo", run_ts.alias("run_ts"), run_id.alias("run_id"),
        *[F.coalesce(F.col(c), zero).alias(c) for c in scores],
        F.coalesce("total", F.lit(0)).cast("long").alias("findings_count"),
        F.coalesce("n_files", F.lit(0)).cast("long").alias("files_analyzed"),
        F.lit(mode).alias("mode"),
    )
