"""The reviewed run as one job: findings of all checks, verdicts on them, the review's own findings, scores, top five, report.

Every step is a named table in a folder. A run that stopped goes on with the first table that is missing; a table counts
only when its job has committed. Findings on several files are judged with their first file, so each has one verdict.
As verdicts come after the checks, the category scores are those of the checks; verdicts change which findings are
counted, ranked and reported. The review is an analyzer of its own, scored where it found something.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators import answers, patches, pyfacts, report, scoring
from lintlake.operators.findings import union_all
from lintlake.options import DEFAULTS, Options
from lintlake.plans.checks import all_findings, all_notes


class Stages:
    """Named tables of one run in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made = spark, folder, []

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of this name, made only if no earlier run has finished it."""
        path = f"{self.folder}/{name}"
        try:
            return self.spark.read.parquet(path)
        except AnalysisException:  # missing, or only files of a job that did not commit
            make().write.mode("overwrite").parquet(path)
            self.made.append(name)
            return self.spark.read.parquet(path)


#: In the order in which a whole run makes them.
TABLES = ["facts", "findings", "notes", "validated", "review", "cards"]


class SmartRun:
    """Tables of a reviewed run, each made when it is first read.

    ``verdicts(findings)`` and ``reviews`` are the reviewer's answers as tables; ``files`` is read for the checks only.
    ``known_facts`` is a folder that runs share: texts that an earlier run parsed are not parsed again.
    """

    def __init__(
        self, files: DataFrame, verdicts: Callable[[DataFrame], DataFrame], reviews: DataFrame, folder: str,
        options: Options = DEFAULTS, known_facts: str | None = None,
    ):
        self.files, self.verdicts, self.reviews, self.options, self.known_facts = files, verdicts, reviews, options, known_facts
        self.stages = Stages(files.sparkSession, folder)

    @cached_property
    def facts(self) -> DataFrame:
        parse = lambda: pyfacts.remembered_facts(self.files, self.known_facts) if self.known_facts else pyfacts.syntax_facts(self.files)
        return self.stages.table("facts", parse)

    @cached_property
    def findings(self) -> DataFrame:
        return self.stages.table("findings", lambda: all_findings(self.files, self.options, self.facts))

    @cached_property
    def notes(self) -> DataFrame:
        return self.stages.table("notes", lambda: all_notes(self.files, self.facts))

    @cached_property
    def validated(self) -> DataFrame:
        return self.stages.table("validated", lambda: answers.validated(self.findings, self.files, self.verdicts(self.findings)))

    @cached_property
    def review(self) -> DataFrame:
        return self.stages.table("review", lambda: answers.review_findings(self.reviews))

    @cached_property
    def kept(self) -> DataFrame:
        return union_all([self.validated, self.review])

    @cached_property
    def cards(self) -> DataFrame:
        return self.stages.table("cards", self._cards)

    def _cards(self) -> DataFrame:
        card = scoring.scorecard(self.findings, self.files, self.options).drop(*scoring.COUNTS)
        counts = answers.dismissal_counts(self.findings, self.validated, self.review)
        left = scoring.severity_counts(self.kept).join(counts, "repo", "full")
        scored = card.join(left, "repo", "left").join(review_scores(self.review).withColumnRenamed("score", "ai_score"), "repo", "left")
        return scored.na.fill(0, [*scoring.COUNTS, "n_before", "n_dismissed", "n_added"])


def review_scores(review: DataFrame) -> DataFrame:
    """(repo, score) of the review's analyzer, for repos in which it found something."""
    ten = F.lit(10).cast("decimal(6,1)")
    lost = F.sum(scoring.points("AI Deep Review", F.col("severity")))
    return review.groupBy("repo").agg(F.greatest(F.lit(1).cast("decimal(6,1)"), ten - lost).cast("decimal(6,1)").alias("score"))


def smart_run(
    files: DataFrame, verdicts: Callable[[DataFrame], DataFrame], reviews: DataFrame, folder: str, options: Options = DEFAULTS,
    known_facts: str | None = None,
) -> SmartRun:
    """The whole run: all tables of a ``SmartRun``, made one after the other."""
    run = SmartRun(files, verdicts, reviews, folder, options, known_facts)
    for name in TABLES:
        getattr(run, name)
    return run


def smart_report(run: SmartRun, files: DataFrame, generated: str, extra: dict | None = None) -> DataFrame:
    """Report lines over the findings that are kept."""
    return report.report_lines(run.kept, run.cards, report.describe(files), run.notes, generated, smart=True, extra=extra or {})


def smart_patches(
    run: SmartRun, files: DataFrame, fixes: Callable[[DataFrame], DataFrame], folder: str, apply: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Patches for the findings that are kept, and the report's section on them (``extra={report.PATCHES: ...}``).

    ``fixes(fixable findings)`` are the reviewer's answers. With ``apply`` the patched files become the table ``patched``
    of the folder; the input stays as it is. Patches with and without ``apply`` are tables of their own.
    """
    stages = Stages(files.sparkSession, folder)
    wanted = stages.table("fixable", lambda: patches.fixable(run.kept, files))
    asked = stages.table("proposed", lambda: patches.proposed(wanted, files, fixes(wanted)))
    name = "patches_applied" if apply else "patches"
    done = stages.table(name, lambda: patches.apply_patches(asked, files, dry_run=not apply))
    if apply:
        stages.table("patched", lambda: patches.patched_files(asked, files))
    return done, patches.patch_section(done, run.cards)
