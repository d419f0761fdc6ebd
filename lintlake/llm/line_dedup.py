"""Line dedup by spread over sites: sketches of the sites of each line, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm import common

#: A line on so many sites is boilerplate.
MIN_SITES = 10
#: log2 of the sketch's registers; its relative standard error is 1.04 / sqrt(2**12) = 1.6 %.
SKETCH_LG_K = 12
#: Estimates within this share of the threshold are counted exactly: six standard errors.
NEAR = 0.1


def normal_line(line: Column) -> Column:
    """Lower case without outer spaces."""
    return F.lower(F.trim(line))


def _lines(documents: DataFrame) -> DataFrame:
    rows = documents.select(
        F.col("doc_id").alias("doc_id"), F.coalesce("source", F.lit("")).alias("site"),
        F.coalesce("text", F.lit("")).alias("body"),
    ).select(
        "*", F.xxhash64("doc_id", "body").alias("row_a"), F.xxhash64("body", "doc_id").alias("row_b"),
        F.xxhash64("body").alias("content"), F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("id"),
    )
    return (
        rows.select("row_a", "row_b", "content", "id", "site", F.posexplode_outer(F.split("body", "\n", -1)).alias("pos", "line"))
        .withColumn("norm", normal_line(F.col("line")))
        .filter(F.col("norm") != "")
        .select(
            "row_a", "row_b", "content", "id", "site", "pos",
            F.xxhash64("norm").alias("h"), F.xxhash64(F.lit(7), "norm").alias("h2"),
        )
    )


def boilerplate_lines(documents: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """Hashes of the lines on ``min_sites`` sites or more, with the estimate and whether it was counted exactly.

    First every (line, site) is pre-aggregated, so a line that fills a third of all rows is one row per task and site.
    Sketches of a line are merged by aggregation; one near the threshold is counted exactly.
    """
    per_site = _lines(documents).groupBy("h", "h2", "site").agg(F.count(F.lit(1)).alias("rows"))
    spread = (
        per_site.groupBy("h", "h2")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_LG_K))).alias("sites"), F.sum("rows").alias("rows"))
        .filter(F.col("sites") >= F.lit(min_sites * (1 - near)))
    )
    close = F.col("sites") <= F.lit(min_sites * (1 + near))
    exact = (
        per_site.join(spread.filter(close).select("h", "h2"), ["h", "h2"], "left_semi")
        .groupBy("h", "h2").agg(F.countDistinct("site").alias("sites"), F.sum("rows").alias("rows"))
        .filter(F.col("sites") >= min_sites)
        .withColumn("counted", F.lit(True))
    )
    return spread.filter(~close).withColumn("counted", F.lit(False)).unionByName(exact)


def _spread(lines: DataFrame, found: DataFrame, min_contents: int) -> DataFrame:
    """The occurrences of the lines of ``found`` that go: those of lines in ``min_contents`` distinct texts or more.

    Copies of one text are one content, so their lines are not boilerplate however many sites have them. Of each line
    the first occurrence stays (smallest doc_id, then row, then position), so no line leaves the corpus altogether.
    """
    first = F.min(F.struct("id", "row_a", "row_b", "pos")).alias("first")
    per_content = lines.join(found, ["h", "h2"], "left_semi").groupBy("h", "h2", "content").agg(first)
    wide = (
        per_content.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("contents"), F.min("first").alias("first"))
        .filter(F.col("contents") >= min_contents)
        .select("h", "h2", F.col("first.row_a").alias("first_a"), F.col("first.row_b").alias("first_b"), F.col("first.pos").alias("first_pos"))
    )
    stays = (F.col("row_a") == F.col("first_a")) & (F.col("row_b") == F.col("first_b")) & (F.col("pos") == F.col("first_pos"))
    return lines.join(wide, ["h", "h2"]).filter(~stays)


def without_boilerplate(documents: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Rows (``doc``: the document with boilerplate lines cut from its ``text``, ``n_lines``, ``n_removed``).

    Null texts stay null, blank lines stay, a null source counts as one site. Every line is decided by itself: it goes
    where it is on ``min_sites`` sites and in as many distinct texts, but for its first occurrence (smallest doc_id).
    Rows that repeat get the same result each.
    """
    lines = _lines(documents)
    found = boilerplate_lines(documents, min_sites).select("h", "h2")
    going = _spread(lines, found, min_sites)
    cut = (
        going.groupBy("row_a", "row_b").agg(F.collect_set("pos").alias("cut_lines"))
        .select(F.col("row_a").alias("cut_a"), F.col("row_b").alias("cut_b"), "cut_lines")
    )
    body = F.coalesce("text", F.lit(""))
    packed = documents.select(
        F.struct(*documents.columns).alias("doc"), F.xxhash64("doc_id", body).alias("row_a"),
        F.xxhash64(body, "doc_id").alias("row_b"),
    )
    joined = packed.join(
        cut, (F.col("row_a") == F.col("cut_a")) & (F.col("row_b") == F.col("cut_b")), "left"
    )
    text = F.col("doc.text")
    parts = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    applies = F.col("cut_lines").isNotNull()
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("cut_lines", i)), "\n")
    fields = [
        F.when(applies, kept).otherwise(text).alias(c) if c == "text" else F.col(f"doc.{c}").alias(c)
        for c in documents.columns
    ]
    return joined.select(
        F.struct(*fields).alias("doc"), F.size(parts).cast("long").alias("n_lines"),
        F.when(applies, F.size("cut_lines")).otherwise(0).cast("long").alias("n_removed"),
    )


def line_report(documents: DataFrame) -> DataFrame:
    """Per document: lines, removed lines, and the digest of the text that stays."""
    kept = without_boilerplate(documents.select("doc_id", "text", "source"))
    digest = F.sha2(F.coalesce("doc.text", F.lit("")), 256).alias("kept_sha256")
    return kept.select("doc.doc_id", "n_lines", "n_removed", digest)


def clean_documents(documents: DataFrame) -> DataFrame:
    """The documents' columns with boilerplate cut line by line; ``n_chars`` is counted anew where a text changed."""
    def field(c: str) -> Column:
        if c != "n_chars":
            return F.col(f"doc.{c}")
        changed = F.when(F.col("n_removed") > 0, F.length("doc.text")).otherwise(F.col("doc.n_chars"))
        return changed.cast(documents.schema[c].dataType).alias(c)

    return without_boilerplate(documents).select(*[field(c) for c in documents.columns])
