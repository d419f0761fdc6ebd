"""Joins and groupings by file over a bucketed files table move no text."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lintlake import sinks
from lintlake.operators import patches
from tests.test_jobs import files_of


def moved(df) -> list[str]:
    """Exchanges of the physical plan whose input holds a content column, as their argument lines."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    nodes = re.findall(r"\(\d+\) (\w*Exchange)\nInput[^\n]*: \[([^\n]*)\]", plan)
    return [f"{kind}: {columns}" for kind, columns in nodes if "content#" in columns]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = [(f"r{i % 3}", f"d/f{i}.py", f"token {i}\n" + "x = 1\n" * (i % 5)) for i in range(300)] + [("r0", "empty.py", "")]
    plain = files_of(spark, rows)
    stored = sinks.write_bucketed_files(plain, "bucketed_files_test", str(tmp_path_factory.mktemp("b") / "files"), 8)
    yield plain, stored
    spark.sql("DROP TABLE bucketed_files_test")


def _patches(spark):
    rows = [(f"r{i % 3}", f"d/f{i}.py", 0, "t", f"token {i}", "safe", "") for i in range(0, 300, 7)]
    schema = "repo string, path string, seq int, finding string, original string, fixed string, explanation string"
    return spark.createDataFrame(rows, schema)


def _without_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def test_patches_move_no_text(spark, tables):
    plain, stored = tables
    _without_broadcast(spark)
    try:
        jobs = [lambda f: patches.patched_files(_patches(spark), f), lambda f: patches.apply_patches(_patches(spark), f, dry_run=False)]
        for job in jobs:
            assert moved(job(plain)) and not moved(job(stored))
            assert sorted(job(stored).collect()) == sorted(job(plain).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_each_bucket_is_one_file(spark, tables):
    plain, stored = tables
    assert stored.select(F.input_file_name()).distinct().count() <= 8
    assert sorted(stored.collect()) == sorted(plain.collect())
