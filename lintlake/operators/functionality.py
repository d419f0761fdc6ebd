"""Functionality checks: open markers, stubs, swallowed exceptions, unused imports, dead code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions import text
from lintlake.operators.findings import (
    FileCheck,
    at_most_one,
    gated,
    item,
    next_text_line,
)
from lintlake.options import Options, is_column

_QUOTES = ['"""', "'''"]
_DEF = text.java_pattern(fv.DEF_PATTERN)


def open_markers(options: Options) -> Column:
    markers = options.todo_markers if is_column(options.todo_markers) else F.array(*[F.lit(m) for m in options.todo_markers])

    def on_line(x: Column) -> Column:
        upper = F.upper(x["raw"])
        return F.transform(
            F.filter(markers, lambda m: F.contains(upper, m)),
            lambda m: item(
                "FUN1",
                line=x["no"],
                severity=F.when(m.isin(fv.TODO_MEDIUM_MARKERS), "medium").otherwise("low"),
                marker=m,
                text=x["txt"],
            ),
        )

    commented = F.filter(F.col("ln"), lambda x: x["raw"].contains("#"))
    return gated(F.col("content").contains("#"), F.flatten(F.transform(commented, on_line)))


def _body_start(x: Column) -> Column:
    """First two body lines after a def, skipping docstrings, comments and blank lines."""
    start = F.struct(
        F.lit(False).alias("in_doc"), F.array().cast("array<string>").alias("body")
    )

    def step(acc: Column, y: Column) -> Column:
        line = y["txt"]
        quoted = text.starts_with_any(line, _QUOTES)
        one_line_doc = (text.count_of(line, _QUOTES[0]) == 2) | (text.count_of(line, _QUOTES[1]) == 2)
        is_code = ~quoted & ~acc["in_doc"] & (line != "") & ~line.startswith("#")
        in_doc = F.when(quoted, ~acc["in_doc"] & ~one_line_doc).otherwise(acc["in_doc"])
        body = F.when(is_code, F.concat(acc["body"], F.array(line))).otherwise(acc["body"])
        return F.when(F.size(acc["body"]) >= 2, acc).otherwise(
            F.struct(in_doc.alias("in_doc"), body.alias("body"))
        )

    window = F.slice(F.col("ln"), x["no"] + F.lit(1), F.lit(9))
    return F.aggregate(window, start, step, lambda acc: acc["body"])


def stub_functions(options: Options) -> Column:
    defs = F.transform(
        F.filter(F.col("ln"), lambda x: x["raw"].rlike(_DEF)),
        lambda x: F.struct(x.alias("x"), _body_start(x).alias("body")),
    )
    stubs = F.filter(
        defs,
        lambda d: (F.size(d["body"]) == 2)
        & F.get(d["body"], F.lit(0)).isin(fv.STUB_BODIES)
        & text.starts_with_any(F.get(d["body"], F.lit(1)), ["def ", "class "]),
    )
    found = F.transform(
        stubs,
        lambda d: item(
            "FUN2",
            line=d["x"]["no"],
            name=F.regexp_extract(d["x"]["raw"], _DEF, 1),
            body=F.get(d["body"], F.lit(0)),
        ),
    )
    return gated(F.col("content").contains("def "), found)


def swallowed_exceptions(options: Options) -> Column:
    hits = F.filter(
        F.col("ln"),
        lambda x: x["txt"].isin(fv.BARE_EXCEPTS)
        & (F.get(F.col("ln"), x["no"])["txt"] == F.lit("pass")),
    )
    return gated(
        F.col("content").contains("except"), F.transform(hits, lambda x: item("FUN3", line=x["no"]))
    )


def imported_names() -> Column:
    """Names bound by import lines, in order, found by pattern."""
    plain = text.java_pattern(fv.IMPORT_PATTERN)
    source = text.java_pattern(fv.FROM_IMPORT_PATTERN)

    def on_line(x: Column) -> Column:
        line = x["txt"]
        listed = F.transform(
            F.split(F.regexp_extract(line, source, 1), ",", -1),
            lambda n: text.strip(F.element_at(F.split(text.strip(n), " as ", -1), -1)),
        )
        return (
            F.when(line.rlike(plain), F.array(F.regexp_extract(line, plain, 1)))
            .when(line.rlike(source), F.filter(listed, lambda n: (n != "") & (n != "*")))
            .otherwise(F.array().cast("array<string>"))
        )

    lines = F.filter(F.col("ln"), lambda x: text.starts_with_any(x["txt"], ["import ", "from "]))
    return F.flatten(F.transform(lines, on_line))


def unused_imports(options: Options) -> Column:
    rest = F.array_join(
        F.transform(
            F.filter(
                F.col("ln"), lambda x: ~text.starts_with_any(x["txt"], ["import ", "from "])
            ),
            lambda x: x["raw"],
        ),
        "\n",
    )
    # One-element arrays bind a value once for the expressions below it.
    unused = F.flatten(F.transform(
        F.array(rest),
        lambda r: F.filter(imported_names(), lambda n: ~F.contains(r, n) & (n != "__")),
    ))
    found = F.flatten(F.transform(
        F.array(unused),
        lambda names: at_most_one(
            F.size(names) > 0,
            item("FUN4", names=F.array_join(F.slice(names, 1, 5), ", "), n=F.size(names)),
        ),
    ))
    return gated(F.col("content").contains("import "), found)


def dead_code(options: Options) -> Column:
    jumps = F.filter(
        F.col("ln"),
        lambda x: x["txt"].isin(fv.JUMP_STATEMENTS) | x["txt"].startswith("return "),
    )
    pairs = F.transform(
        jumps, lambda x: F.struct(x.alias("x"), next_text_line(x, 4).alias("y"))
    )
    dead = F.filter(
        pairs,
        lambda p: p["y"].isNotNull()
        & (text.indent_width(p["y"]["raw"]) > text.indent_width(p["x"]["raw"]))
        & ~text.starts_with_any(p["y"]["txt"], fv.REACHABLE_STARTS),
    )
    found = F.transform(
        dead,
        lambda p: item("FUN5", line=p["y"]["no"], text=p["x"]["txt"], from_line=p["x"]["no"]),
    )
    return gated(text.contains_any(F.col("content"), fv.JUMP_STATEMENTS), found)


FILE_CHECKS = [
    FileCheck("FUN1", "Functionality", 0, 0, open_markers),
    FileCheck("FUN2", "Functionality", 0, 1, stub_functions),
    FileCheck("FUN3", "Functionality", 0, 2, swallowed_exceptions),
    FileCheck("FUN4", "Functionality", 0, 3, unused_imports),
    FileCheck("FUN5", "Functionality", 0, 4, dead_code),
]
