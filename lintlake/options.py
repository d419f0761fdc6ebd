"""Parameters of the checks. Per-repository overrides are resolved by ``sources.overrides``."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column

from lintlake import fixed_values as fv


@dataclass(frozen=True)
class Options:
    weights: dict[str, Decimal] = field(default_factory=lambda: {
        "quality": Decimal("0.30"),
        "structure": Decimal("0.25"),
        "security": Decimal("0.25"),
        "usefulness": Decimal("0.20"),
    })
    max_function_lines: int = 50
    nesting_threshold: int = 5
    magic_number_whitelist: tuple[float, ...] = tuple(fv.MAGIC_NUMBER_WHITELIST)
    magic_number_threshold: int = 10
    allowed_single_letter_vars: str = fv.ALLOWED_SINGLE_LETTERS
    todo_markers: tuple[str, ...] = tuple(fv.TODO_MARKERS)
    root_file_threshold: int = 5
    mixed_concern_threshold: int = 3
    block_size: int = 3
    min_block_length: int = 30
    import_repetition_threshold: int = 3


DEFAULTS = Options()


def is_column(value: object) -> bool:
    """Whether a setting is read from the rows (``overrides.column_options``) rather than the same for all."""
    return isinstance(value, Column)
