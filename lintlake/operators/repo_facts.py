"""One pass of per-repository facts for every repository-scoped check.

Each fact is a boolean, a counter or a bit mask, so the whole pass is a single hash aggregate with
fixed-size buffers: rows of a repository are reduced inside every map task and only one small row per
(task, repo) is shuffled, however large one repository is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions import text
from lintlake.functions.memo import per_application

_API = text.java_pattern(fv.TOP_LEVEL_DEF_PATTERN)


def mask_of(flags: list[Column]) -> Column:
    """Bit i is set where flag i holds."""
    bits = [F.when(flag, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, flag in enumerate(flags)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def names_in(mask: Column, names: list[str], present: bool = True) -> Column:
    """The names whose bit is set (or not set), in list order."""
    wanted = F.lit(1 if present else 0)
    entries = F.array(*[
        F.when(F.shiftright(mask, i).bitwiseAND(F.lit(1)) == wanted, F.lit(name))
        for i, name in enumerate(names)
    ])
    return F.array_compact(entries)


def concern(path: Column, content: Column) -> Column:
    """Index into CONCERNS; the first rule that matches decides."""
    name = F.lower(text.basename(path))
    return (
        F.when(name.contains("config") | name.isin(fv.CONFIG_NAMES), 0)
        .when(name.startswith("test_") | name.endswith("_test.py"), 1)
        .when(
            text.contains_any(content, ["tkinter", "tk."]) | text.contains_any(name, ["gui", "overlay"]),
            2,
        )
        .when(text.ends_with_any(name, fv.SCRIPT_SUFFIXES), 3)
        .otherwise(4)
    )


def cli_opportunity(content: Column) -> Column:
    return text.contains_any(content, fv.MAIN_GUARDS) & ~text.contains_any(content, fv.CLI_LIBRARIES)


def top_level_functions(content: Column) -> Column:
    return F.when(
        content.contains("def "), F.size(F.regexp_extract_all(content, F.lit(_API), F.lit(0)))
    ).otherwise(0)


def api_opportunity(content: Column) -> Column:
    return (top_level_functions(content) > 5) & ~text.contains_any(F.lower(content), fv.API_LIBRARIES)


FACTS = {
    "n_files": lambda p, c: F.count(F.lit(1)),
    "n_root_code": lambda p, c: F.count_if(
        text.is_root(p) & text.ends_with_any(p, fv.ROOT_CODE_SUFFIXES)
    ),
    "root_concerns": lambda p, c: F.bit_or(
        F.when(text.is_root(p), F.call_function("shiftleft", F.lit(1), concern(p, c))).otherwise(0)
    ),
    "n_py": lambda p, c: F.count_if(p.endswith(".py")),
    "has_packaging": lambda p, c: F.bool_or(text.basename(p).isin(fv.PACKAGING_NAMES)),
    "has_env": lambda p, c: F.bool_or(p == ".env"),
    "has_ignore": lambda p, c: F.bool_or((p == ".gitignore") & (c != "")),
    "ignore_entries": lambda p, c: F.bit_or(
        F.when(p == ".gitignore", mask_of([c.contains(e) for e in fv.IGNORE_ENTRIES])).otherwise(F.lit(0).cast("long"))
    ),
    "has_ci": lambda p, c: F.bool_or(text.contains_any(p, fv.CI_INDICATORS)),
    "n_test_py": lambda p, c: F.count_if(F.lower(p).contains("test") & p.endswith(".py")),
    "n_code_py": lambda p, c: F.count_if(
        p.endswith(".py") & ~F.lower(p).contains("test") & ~p.contains("__pycache__")
    ),
    "has_lint": lambda p, c: F.bool_or(text.contains_any(p, fv.LINT_INDICATORS)),
    "n_hooks": lambda p, c: F.coalesce(F.sum(
        F.when(cli_opportunity(c), 1).otherwise(0) + F.when(api_opportunity(c), 1).otherwise(0)
    ), F.lit(0)),
}


def repo_facts(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Facts per repository; only the columns the named facts need are read."""
    return files.groupBy("repo").agg(*[_fact(n) for n in names or list(FACTS)])


@per_application
def _fact(name: str) -> Column:
    return FACTS[name](F.col("path"), F.col("content")).alias(name)
