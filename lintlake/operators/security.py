"""Security checks: hard-coded secrets, unsafe calls, tracked .env, missing ignore file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions import text
from lintlake.functions.prefilter import may_match
from lintlake.operators.findings import FileCheck, empty, gated, item
from lintlake.options import Options


def _pattern_items(patterns: list[tuple[str, str]], message: str) -> Column:
    """One finding per pattern and hit; literal patterns, so each is compiled once per task."""

    def hits(pattern: str, title: str) -> Column:
        lines = text.match_lines(F.col("content"), pattern)
        found = F.transform(lines, lambda line: item(message, line=line, title=F.lit(title)))
        return gated(may_match(F.col("content"), pattern), found)

    return F.concat(*[hits(pattern, title) for pattern, title in patterns])


def secrets(options: Options) -> Column:
    skipped = text.ends_with_any(F.col("path"), fv.SECRET_SKIP_SUFFIXES)
    return F.when(skipped, empty()).otherwise(_pattern_items(fv.SECRET_PATTERNS, "SEC1"))


def unsafe_calls(options: Options) -> Column:
    return _pattern_items(fv.UNSAFE_PATTERNS, "SEC2")


FILE_CHECKS = [
    FileCheck("SEC1", "Security", 0, 0, secrets),
    FileCheck("SEC2", "Security", 0, 1, unsafe_calls),
]
