"""Streaming use of the stateless checks.

The rules define no streaming operator: there is no watermark, window or state to keep. The file-scoped
checks are one projection and one explode per file, so they accept a streaming files table as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from lintlake.operators.findings import file_findings
from lintlake.options import DEFAULTS, Options
from lintlake.plans.checks import FILE_CHECKS


def append_file_findings(
    files: DataFrame, path: str, checkpoint: str, options: Options = DEFAULTS
) -> StreamingQuery:
    """Append the file-scoped findings of newly arrived files to a table, then stop."""
    return (
        file_findings(files, FILE_CHECKS, options)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
