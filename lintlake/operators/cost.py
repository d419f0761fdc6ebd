"""Size-based cost estimate of the external review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake import fixed_values as fv


def estimate_cost(files: DataFrame, mode: str = "smart") -> DataFrame:
    if mode not in fv.COST_MODES:
        raise ValueError(f"unknown mode: {mode}; expected one of {fv.COST_MODES}")
    totals = files.groupBy("repo").agg(
        F.sum(F.length("content")).alias("chars"), F.count(F.lit(1)).alias("file_count")
    )
    tokens = totals.select(
        "repo", "file_count", F.expr(f"chars div {fv.CHARS_PER_TOKEN}").alias("input_tokens")
    )
    if mode == "smart":
        tokens = tokens.withColumn(
            "input_tokens", F.expr(f"input_tokens div {fv.SMART_INPUT_SHARE}")
        ).withColumn("output_tokens", F.lit(fv.SMART_OUTPUT_TOKENS).cast("long"))
    else:
        tokens = tokens.withColumn(
            "output_tokens", F.expr(f"input_tokens div {fv.AUTO_FIX_OUTPUT_SHARE}")
        )
    micro_usd = (
        F.col("input_tokens") * fv.USD_PER_MILLION_INPUT
        + F.col("output_tokens") * fv.USD_PER_MILLION_OUTPUT
    ).cast("decimal(24,6)")
    return tokens.select(
        "repo", "input_tokens", "output_tokens",
        F.round(micro_usd / F.lit(1_000_000).cast("decimal(7,0)"), 4).cast("decimal(18,4)")
        .alias("estimated_cost_usd"),
        "file_count",
    )
