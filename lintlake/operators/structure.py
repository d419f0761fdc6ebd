"""File-scoped structure check: constants written into logic files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake.functions import text
from lintlake.operators.findings import FileCheck, at_most_one, gated, item
from lintlake.options import Options

_ASSIGNMENTS = ["= 0.", '= "']


def hardcoded_constants(options: Options) -> Column:
    constants = F.filter(
        F.col("ln"),
        lambda x: text.contains_any(x["txt"], _ASSIGNMENTS)
        & (F.upper(x["txt"]) == x["txt"])
        & (F.lower(x["txt"]) != x["txt"]),
    )
    n = F.size(constants)
    return gated(
        ~F.lower(F.col("path")).contains("config") & text.contains_any(F.col("content"), _ASSIGNMENTS),
        F.flatten(F.transform(F.array(n), lambda k: at_most_one(k > 3, item("STR4", n=k)))),
    )


FILE_CHECKS = [FileCheck("STR4", "Structure", 3, 0, hardcoded_constants)]
