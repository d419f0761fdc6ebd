"""Text expressions with Python string semantics, all evaluated on the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake import fixed_values as fv

# Private-use code points that mark match starts; see ``match_lines``.
_MARK = "\ue000"
_MARK_STAND_IN = "\ue001"

_WORD = r"[\p{L}\p{N}_]"
_SPACE = r"[\s\x1c-\x1f]"


def java_pattern(pattern: str) -> str:
    """Python ``re`` notation -> Java notation with Python's Unicode classes and line ends.

    Java's ``\\w``, ``\\s``, ``\\d`` and ``\\b`` are ASCII by default and differ slightly from Python's
    even with ``(?U)``, so they are spelled out. ``d`` makes ``.`` and ``^`` treat only LF as a line end.
    """
    spelled = {
        r"\w": _WORD,
        r"\s": _SPACE,
        r"\S": r"[^\s\x1c-\x1f]",
        r"\d": r"\p{Nd}",
        r"\b": rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))",
    }
    return "(?Ud)" + re.sub(r"\\[wsSdb]", lambda m: spelled[m.group(0)], pattern)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(fv.WHITESPACE))


def indent_width(c: Column) -> Column:
    return F.length(c) - F.length(F.ltrim(c, F.lit(fv.WHITESPACE)))


def split_lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def count_of(c: Column, needle: str | Column) -> Column:
    """Non-overlapping occurrences of a non-empty literal."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    removed = F.length(c) - F.length(F.replace(c, needle, F.lit("")))
    return (removed / F.length(needle)).cast("int")


def contains_any(c: Column, needles: list[str]) -> Column:
    return _any_of([c.contains(n) for n in needles])


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    return _any_of([c.startswith(p) for p in prefixes])


def ends_with_any(c: Column, suffixes: list[str]) -> Column:
    return _any_of([c.endswith(s) for s in suffixes])


def _any_of(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result | condition
    return result


def fill(template: str, **values: Column) -> Column:
    """``"Line {line}: ..."`` with columns in place of the names."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            parts.append(values[piece].cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def fill_options(template: str, **values: object) -> str:
    """Replace names whose value is already known on the driver, keep the others."""
    for name, value in values.items():
        template = template.replace("{" + name + "}", str(value))
    return template


def match_lines(content: Column, pattern: str) -> Column:
    """Line number of every regex match over the whole text, in order, as ``array<int>``.

    Each match start is marked with one private-use character, then the marked text is cut into
    lines: the marks on line n are the matches that start there. Work is linear in the text, and texts
    without a match never get cut. Such characters in the input are swapped first, which no pattern
    can notice (they are neither word characters, nor space, nor ASCII).
    """
    java = java_pattern(pattern)
    marked = F.regexp_replace(F.translate(content, _MARK, _MARK_STAND_IN), java, _MARK + "$0")
    per_line = F.transform(
        F.split(marked, "\n", -1),
        lambda line, i: F.when(
            line.contains(_MARK), F.array_repeat(i + F.lit(1), count_of(line, _MARK))
        ).otherwise(F.array().cast("array<int>")),
    )
    return F.when(content.rlike(java), F.flatten(per_line)).otherwise(F.array().cast("array<int>"))


# --- arrays to rows -------------------------------------------------------------------------


def explode_rows(df: DataFrame, keep: list[str], array: Column, name: str) -> DataFrame:
    """``explode`` for arrays that are costly to compute.

    For a plain explode the optimizer adds a filter ``size(array) > 0`` and pushes it to the scan, with
    the array expression and everything below it copied into the filter, even into lambda bodies. The
    outer form computes the array once; the null row of an empty array is dropped right after.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def inline_rows(df: DataFrame, keep: list[str], array: Column) -> DataFrame:
    """``explode_rows`` for an array of structs, one column per field."""
    return explode_rows(df, keep, array, "_item").select(*keep, "_item.*")


# --- paths -----------------------------------------------------------------------------------


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def suffix(path: Column) -> Column:
    """Like ``pathlib``: last dot of the name, not a leading one, not a trailing one."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.substr(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def is_root(path: Column) -> Column:
    return ~path.contains("/")
