"""Literals that a text must contain for a pattern to match, taken from the pattern itself.

A search for literals costs a fraction of a search for a pattern, and most texts have none of them.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake.functions import text

#: Characters that match an ASCII letter when case is ignored, though their lower case is another one.
_ODD_CASE = ["İ", "ı", "ſ"]


def _best(choices: list[set[str] | None]) -> set[str] | None:
    """The choice whose shortest literal is longest."""
    known = [c for c in choices if c]
    return max(known, key=lambda c: (min(map(len, c)), -len(c))) if known else None


def _needed(tree) -> set[str] | None:
    choices, run = [], ""
    for kind, value in [*tree, (None, None)]:
        if kind is op.LITERAL:
            run += chr(value)
            continue
        if run:
            choices.append({run})
            run = ""
        if kind is op.SUBPATTERN:
            choices.append(_needed(value[-1]))
        elif kind is op.BRANCH:
            parts = [_needed(p) for p in value[1]]
            choices.append(set().union(*parts) if all(parts) else None)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0]:
            choices.append(_needed(value[2]))
    return _best(choices)


def required_literals(pattern: str) -> tuple[list[str], bool] | None:
    """(literals, whether case is ignored): every text that the pattern matches has one of them. None: there is no such set."""
    tree = parser.parse(pattern)
    ignore = bool(tree.state.flags & re.IGNORECASE)
    found = _needed(tree)
    if not found or any(not x.isascii() for x in found):
        return None
    return sorted({x.lower() for x in found} if ignore else found), ignore


def may_match(content: Column, pattern: str) -> Column:
    """False only where the pattern can't match."""
    required = required_literals(pattern)
    if required is None:
        return F.lit(True)
    literals, ignore = required
    if not ignore:
        return text.contains_any(content, literals)
    return text.contains_any(F.lower(content), literals) | text.contains_any(content, _ODD_CASE)
