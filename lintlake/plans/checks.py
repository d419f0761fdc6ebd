"""Registry of checks and the job that produces the findings table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.operators import (
    clarity,
    functionality,
    pyfacts,
    repo_checks,
    reusability,
    security,
    structure,
)
from lintlake.operators.findings import FINDINGS_SCHEMA, file_findings, finding_rows, union_all
from lintlake.options import DEFAULTS, Options

FILE_CHECKS = [
    *structure.FILE_CHECKS,
    *reusability.FILE_CHECKS,
    *clarity.FILE_CHECKS,
    *functionality.FILE_CHECKS,
    *security.FILE_CHECKS,
]


@dataclass(frozen=True)
class CustomCheck:
    """A user check: ``fn(files) -> findings`` with the columns of the findings table."""

    check_id: str
    analyzer: str
    scope: str
    fn: Callable[[DataFrame], DataFrame]


_REGISTERED: dict[str, CustomCheck] = {}


def register_check(check_id: str, analyzer: str, scope: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Add a check. ``scope`` is 'line', 'file' or 'repo' (documentation of what it looks at)."""
    if scope not in ("line", "file", "repo"):
        raise ValueError(f"unknown scope: {scope}")
    _REGISTERED[check_id] = CustomCheck(check_id, analyzer, scope, fn)


def unregister_check(check_id: str) -> None:
    _REGISTERED.pop(check_id, None)


def _validated(check: CustomCheck, rows: DataFrame) -> DataFrame:
    wanted = dict(part.split(" ", 1) for part in FINDINGS_SCHEMA.split(", "))
    missing = [c for c in wanted if c not in rows.columns]
    if missing:
        raise ValueError(f"check {check.check_id} lacks columns {missing}")
    return rows.select(*[F.col(c).cast(t).alias(c) for c, t in wanted.items()])


def all_findings(
    files: DataFrame, options: Options = DEFAULTS, facts: DataFrame | None = None
) -> DataFrame:
    """UNION ALL of every check over every repo; nothing is de-duplicated."""
    facts = facts if facts is not None else pyfacts.syntax_facts(files)
    return union_all([
        file_findings(files, FILE_CHECKS, options),
        repo_checks.repo_findings(files, options=options),
        reusability.duplicate_block_findings(files, options),
        reusability.repeated_import_findings(files, options),
        pyfacts.fact_findings(facts),
        *[_validated(c, c.fn(files)) for c in _REGISTERED.values()],
    ])


def all_notes(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    facts = facts if facts is not None else pyfacts.syntax_facts(files)
    return union_all([
        repo_checks.ignore_notes(files),
        repo_checks.hook_notes(files),
        pyfacts.syntax_notes(facts),
    ])


__all__ = ["CustomCheck", "all_findings", "all_notes", "finding_rows", "register_check", "unregister_check"]
