"""Generated tests: paths, de-duplication, counts, report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import text
from lintlake.operators.answers import unfenced


def test_path(path: Column) -> Column:
    return F.concat(F.lit("tests/test_"), text.stem(path), F.lit(".py"))


def test_count(code: Column) -> Column:
    """A test on the very first line is not counted."""
    return text.count_of(code, "\ndef test_") + text.count_of(code, "\nasync def test_")


def answered_tests(responses: DataFrame) -> DataFrame:
    """``responses(repo, path, text)`` -> one row per usable answer."""
    code = unfenced(F.col("text"))
    return responses.select("repo", "path", code.alias("code")).filter(F.col("code").isNotNull()).select(
        "repo", "path", test_path(F.col("path")).alias("test_path"), "code",
        test_count(F.col("code")).alias("num_tests"),
    )


def generated_tests(answers: DataFrame) -> DataFrame:
    """One file per test path; of equal stems the last path wins."""
    last = F.max_by(F.struct("path", "code", "num_tests"), F.col("path")).alias("t")
    return answers.groupBy("repo", "test_path").agg(last).select(
        "repo", "test_path", F.col("t.path").alias("source_path"), "t.code", "t.num_tests"
    )


def test_totals(answers: DataFrame) -> DataFrame:
    """Tests over all answers (also overwritten ones) and number of resulting files."""
    per_path = answers.groupBy("repo", "test_path").agg(F.sum("num_tests").alias("n"))
    return per_path.groupBy("repo").agg(
        F.sum("n").alias("tests_generated"), F.count(F.lit(1)).alias("n_files")
    )


def test_lines(answers: DataFrame, written: bool = False) -> DataFrame:
    """Report rows (repo, block, name, line_no, line); blocks: 0 head, 1 files written, 2 code."""
    rows = generated_tests(answers)
    totals = test_totals(answers)
    listing = F.lit("### Files Written")
    head = F.array(
        F.lit("## Generated Tests"), F.lit(""),
        F.concat(F.lit("**"), F.col("tests_generated"), F.lit(" tests** generated across **"),
                 F.col("n_files"), F.lit(" files**")),
        F.lit(""), *([listing] if written else []),
    )
    body = F.concat(
        F.array(F.concat(F.lit("### `"), F.col("test_path"), F.lit("`")), F.lit("```python")),
        F.split("code", "\n", -1),
        F.array(F.lit("```"), F.lit("")),
    )
    parts = totals.select("repo", F.lit(0).alias("block"), F.lit("").alias("name"),
                          F.posexplode_outer(head).alias("line_no", "line"))
    if written:
        entry = rows.select("repo", F.lit(1).alias("block"), F.col("test_path").alias("name"),
                            F.lit(0).alias("line_no"),
                            F.concat(F.lit("- `"), F.col("test_path"), F.lit("`")).alias("line"))
        # Blank line between the list and the first code block.
        blank = totals.select("repo", F.lit(2).alias("block"), F.lit("").alias("name"),
                              F.lit(0).alias("line_no"), F.lit("").alias("line"))
        parts = parts.unionByName(entry).unionByName(blank)
    code = rows.select("repo", F.lit(2).alias("block"), F.col("test_path").alias("name"),
                       F.posexplode_outer(body).alias("line_no", "line"))
    return parts.unionByName(code)
