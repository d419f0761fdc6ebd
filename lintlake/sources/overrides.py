"""Per-repo parameter look-up over up to three override tables, first existing one wins."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.options import DEFAULTS, Options

#: Settings that checks compare with, by section and key; each is a field of ``Options``.
NUMERIC = {
    ("clarity", "max_function_lines"): "max_function_lines",
    ("clarity", "nesting_threshold"): "nesting_threshold",
    ("clarity", "magic_number_threshold"): "magic_number_threshold",
    ("structure", "root_file_threshold"): "root_file_threshold",
    ("structure", "mixed_concern_threshold"): "mixed_concern_threshold",
    ("reusability", "block_size"): "block_size",
    ("reusability", "min_block_length"): "min_block_length",
    ("reusability", "import_repetition_threshold"): "import_repetition_threshold",
}
#: Settings that are lists (written with commas) or sets of letters, and their types.
LISTS = {
    ("clarity", "magic_number_whitelist"): "array<double>",
    ("clarity", "allowed_single_letter_vars"): "string",
    ("functionality", "todo_markers"): "array<string>",
}
#: Shares of the overall score, section ``scoring``.
WEIGHTS = ("quality", "structure", "security", "usefulness")


def effective_overrides(repos: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """``sources`` in priority order, each (repo, section, key, value).

    A repo takes all of its settings from the first source that has any row for it, like the first
    configuration file found; sources are not mixed.
    """
    ranked = reduce(
        DataFrame.unionByName,
        [s.select("repo", "section", "key", "value").withColumn("priority", F.lit(i))
         for i, s in enumerate(sources)],
    )
    winner = ranked.groupBy("repo").agg(F.min("priority").alias("priority"))
    return ranked.join(winner, ["repo", "priority"]).join(repos.select("repo"), "repo", "left_semi")


def option_values(repos: DataFrame, overrides: DataFrame, defaults: dict[tuple[str, str], str]) -> DataFrame:
    """One column ``section_key`` per default, overridden where the repo has a value."""
    wide = overrides.groupBy("repo").agg(*[
        F.max(F.when((F.col("section") == s) & (F.col("key") == k), F.col("value"))).alias(f"{s}_{k}")
        for s, k in defaults
    ])
    return repos.select("repo").join(wide, "repo", "left").select(
        "repo",
        *[F.coalesce(F.col(f"{s}_{k}"), F.lit(v)).alias(f"{s}_{k}") for (s, k), v in defaults.items()],
    )


def repo_options(repos: DataFrame, overrides: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """One row per repo with a typed ``opt_`` column per setting.

    A value that is no number, or a list with an entry that is none, keeps the default; so does a block size under 1.
    """
    defaults = {k: str(getattr(options, f)) for k, f in NUMERIC.items()}
    defaults |= {("scoring", w): str(options.weights[w]) for w in WEIGHTS}
    for section, key in LISTS:
        value = getattr(options, key)
        defaults[section, key] = value if isinstance(value, str) else ",".join(map(str, value))
    wide = option_values(repos, overrides, defaults)

    def typed(key: tuple[str, str], kind: str, name: str):
        value = F.coalesce(F.expr(f"try_cast({key[0]}_{key[1]} AS {kind})"), F.lit(defaults[key]).cast(kind))
        if name == "block_size":
            value = F.when(value >= 1, value).otherwise(F.lit(defaults[key]).cast(kind))
        return value.alias(f"opt_{name}")

    def listed(key: tuple[str, str], kind: str):
        own, name = F.col(f"{key[0]}_{key[1]}"), f"opt_{key[1]}"
        if kind == "string":
            return own.alias(name)
        entries = lambda c: F.transform(F.split(c, ",", -1), lambda x: F.trim(x))
        if kind == "array<string>":
            return F.filter(entries(own), lambda x: x != "").alias(name)
        numbers = lambda c: F.transform(entries(c), lambda x: x.try_cast("double"))
        usable = ~F.exists(numbers(own), lambda x: x.isNull())
        return F.when(usable, numbers(own)).otherwise(numbers(F.lit(defaults[key]))).alias(name)

    return wide.select(
        "repo", *[typed(k, "int", f) for k, f in NUMERIC.items()],
        *[typed(("scoring", w), "decimal(4,2)", f"weight_{w}") for w in WEIGHTS],
        *[listed(k, kind) for k, kind in LISTS.items()],
    )


def column_options(options: Options = DEFAULTS) -> Options:
    """Options that checks read from the ``opt_`` columns of their rows."""
    return replace(
        options, **{f: F.col(f"opt_{f}") for f in [*NUMERIC.values(), *[key for _, key in LISTS]]},
        weights={w: F.col(f"opt_weight_{w}") for w in WEIGHTS},
    )
