"""Clarity checks: naming, function length, docstrings, magic numbers, nesting."""

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

_DEF = text.java_pattern(fv.DEF_PATTERN)
_DEF_OR_CLASS = text.java_pattern(fv.DEF_OR_CLASS_PATTERN)
_LETTER = text.java_pattern(fv.SINGLE_LETTER_PATTERN)
_NUMBER = text.java_pattern(fv.NUMBER_PATTERN)
_QUOTES = ['"""', "'''"]


def single_letters(options: Options) -> Column:
    letters = options.allowed_single_letter_vars
    allowed = (lambda m: F.contains(letters, m)) if is_column(letters) else (lambda m: m.isin(list(letters)))
    candidates = F.filter(
        F.col("ln"),
        lambda x: x["raw"].contains("=") & ~text.starts_with_any(x["txt"], ["#", "def "]),
    )
    named = F.transform(
        candidates,
        lambda x: F.struct(
            x["no"].alias("no"),
            F.filter(
                F.regexp_extract_all(x["raw"], F.lit(_LETTER), F.lit(1)), lambda m: ~allowed(m)
            ).alias("names"),
        ),
    )
    found = F.transform(
        F.filter(named, lambda x: F.size(x["names"]) > 0),
        lambda x: item("CLA1", line=x["no"], names=F.array_join(x["names"], ", ")),
    )
    return gated(F.col("content").contains("="), found)


def long_functions(options: Options) -> Column:
    defs = F.filter(F.col("ln"), lambda x: x["raw"].rlike(_DEF))
    measured = F.flatten(F.transform(
        F.array(defs),
        lambda ds: F.transform(
            ds,
            lambda d, i: F.struct(
                d["no"].alias("no"),
                d["raw"].alias("raw"),
                (
                    F.coalesce(F.get(ds, i + F.lit(1))["no"], F.size(F.col("ln")) + F.lit(1)) - d["no"]
                ).alias("n"),
            ),
        ),
    ))
    found = F.transform(
        F.filter(measured, lambda d: d["n"] > options.max_function_lines),
        lambda d: item(
            "CLA2",
            line=d["no"],
            name=F.regexp_extract(d["raw"], _DEF, 1),
            n=d["n"],
            limit=F.lit(options.max_function_lines),
        ),
    )
    return gated(F.col("content").contains("def "), found)


def missing_docstrings(options: Options) -> Column:
    heads = F.transform(
        F.filter(F.col("ln"), lambda x: x["raw"].rlike(_DEF_OR_CLASS)),
        lambda x: F.struct(
            F.regexp_extract(x["raw"], _DEF_OR_CLASS, 1).alias("kind"),
            F.regexp_extract(x["raw"], _DEF_OR_CLASS, 2).alias("name"),
            next_text_line(x, 2)["txt"].alias("next"),
        ),
    )
    missing = F.transform(
        F.filter(
            heads,
            lambda h: ~((h["kind"] == "def") & h["name"].startswith("_"))
            & h["next"].isNotNull()
            & ~text.starts_with_any(h["next"], _QUOTES),
        ),
        lambda h: h["name"],
    )
    found = F.flatten(F.transform(
        F.array(missing),
        lambda names: at_most_one(
            F.size(names) > 3,
            item("CLA3", n=F.size(names), names=F.array_join(F.slice(names, 1, 5), ", ")),
        ),
    ))
    return gated(text.contains_any(F.col("content"), ["def ", "class "]), found)


def magic_numbers(options: Options) -> Column:
    ignored = ["#", "def ", "class ", "import", "from"]
    numbers = options.magic_number_whitelist
    listed = (
        (lambda x: F.array_contains(numbers, x)) if is_column(numbers) else (lambda x: x.isin([float(v) for v in numbers]))
    )
    lines = F.filter(F.col("ln"), lambda x: ~text.starts_with_any(x["txt"], ignored))
    magic = F.aggregate(
        lines,
        F.lit(0),
        lambda n, x: n + F.size(F.filter(
            F.regexp_extract_all(x["txt"], F.lit(_NUMBER), F.lit(1)),
            lambda m: F.coalesce(~listed(m.try_cast("double")), F.lit(True)),
        )),
    )
    found = F.flatten(F.transform(
        F.array(magic),
        lambda n: at_most_one(n > options.magic_number_threshold, item("CLA4", n=n)),
    ))
    return gated(
        ~F.lower(F.col("path")).contains("config") & F.col("content").rlike(r"\p{Nd}"), found
    )


def deep_nesting(options: Options) -> Column:
    depths = F.transform(
        F.filter(F.col("ln"), lambda x: x["txt"] != ""),
        lambda x: F.struct(
            F.floor(text.indent_width(x["raw"]) / 4).cast("int").alias("depth"),
            (-x["no"]).alias("back"),
        ),
    )
    # The largest depth, and for that depth the first line.
    found = F.flatten(F.transform(
        F.array(F.array_max(depths)),
        lambda d: at_most_one(
            d["depth"] >= options.nesting_threshold, item("CLA5", line=-d["back"], n=d["depth"])
        ),
    ))
    return found


FILE_CHECKS = [
    FileCheck("CLA1", "Clarity", 0, 0, single_letters),
    FileCheck("CLA2", "Clarity", 0, 1, long_functions),
    FileCheck("CLA3", "Clarity", 0, 2, missing_docstrings),
    FileCheck("CLA4", "Clarity", 0, 3, magic_numbers),
    FileCheck("CLA5", "Clarity", 0, 4, deep_nesting),
]
