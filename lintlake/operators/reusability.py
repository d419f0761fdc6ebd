"""Reusability checks: blocks shared between files, repeated import sets, long inline expressions.

Shared groups may be huge (a licence header can sit in a third of all files), so no group is ever
collected whole, whatever its size:

* a block or import set travels as two 64-bit hashes; counts and first members are partial aggregates;
* a finding names the first file and the number of further ones;
* the complete membership is a row table (``block_files``, ``import_set_files``);
* texts are read a second time for the first file of each group only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import text
from lintlake.functions.ranking import durable
from lintlake.operators.findings import FileCheck, finding_rows, gated, item
from lintlake.options import DEFAULTS, Options, is_column

#: Files of one block that are joined under one key, about.
SPLIT = 1000


def _code_lines() -> Column:
    return F.filter(
        F.transform(text.split_lines(F.col("content")), text.strip),
        lambda t: (t != "") & ~t.startswith("#"),
    )


def windows(code: Column, options: Options) -> Column:
    """Sliding blocks of ``block_size`` lines: array of (idx, block), short blocks dropped."""
    size = options.block_size
    blocks = F.when(
        F.size(code) >= size,
        F.transform(
            F.sequence(F.lit(1), F.size(code) - F.lit(size - 1)),
            lambda i: F.struct(
                i.alias("idx"), F.array_join(F.slice(code, i, F.lit(size)), "\n").alias("block")
            ),
        ),
    )
    return F.filter(blocks, lambda b: F.length(b["block"]) >= options.min_block_length)


def _value(setting: int | Column) -> Column:
    return setting if is_column(setting) else F.lit(setting)


def _scoped(files: DataFrame, scope: str) -> DataFrame:
    if scope == "repo":
        return files
    if scope == "corpus":
        return files.withColumn("path", F.concat_ws("/", "repo", "path")).withColumn(
            "repo", F.lit("(corpus)")
        )
    raise ValueError(f"unknown scope: {scope}")


_BLOCK = ["repo", "h", "h2"]


def _block_members(files: DataFrame, options: Options, scope: str) -> DataFrame:
    """(repo, h, h2, path, idx): every distinct block of a file by its two hashes, first position in the file.

    Lines are hashed once; a block's hashes are those of its lines' hashes, so no block is built as a text. The
    width may differ by row.
    """
    scoped = _scoped(files, scope)
    line = lambda t: F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(1), t).alias("b"), F.length(t).alias("n"))
    width = _value(options.block_size)
    hashed = scoped.select("repo", "path", width.alias("width"), _value(options.min_block_length).alias("least"),
                           F.transform(_code_lines(), line).alias("code"))
    part = lambda name, i: F.slice(F.col("code")[name], i, F.col("width"))
    chars = lambda i: F.aggregate(part("n", i), F.col("width") - 1, lambda x, y: x + y)
    starts = F.when(F.size("code") >= F.col("width"), F.sequence(F.lit(1), F.size("code") - F.col("width") + 1))
    blocks = F.transform(
        F.filter(starts, lambda i: chars(i) >= F.col("least")),
        lambda i: F.struct(F.xxhash64(part("a", i)).alias("h"), F.xxhash64(part("b", i)).alias("h2"), i.alias("idx")),
    )
    in_order = hashed.select("repo", "path", F.array_sort(blocks).alias("sorted"))
    row = F.col("sorted")
    first = F.filter(row, lambda b, i: (i == 0) | (row[i - 1]["h"] != b["h"]) | (row[i - 1]["h2"] != b["h2"]))
    return text.inline_rows(in_order, ["repo", "path"], first)


def _sizes(members: DataFrame, key: list[str], least: int | Column) -> DataFrame:
    """Groups of at least ``least`` files: size and first (path, idx), as partial aggregates."""
    return members.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_files"), F.min(F.struct("path", "idx")).alias("first")
    ).filter(F.col("n_files") >= least)


def block_sizes(files: DataFrame, options: Options = DEFAULTS, scope: str = "repo") -> DataFrame:
    """One row per shared block, without its text: (repo, h, h2, n_files, first)."""
    return _sizes(_block_members(files, options, scope), _BLOCK, 2)


def duplicate_blocks(files: DataFrame, options: Options = DEFAULTS, scope: str = "repo") -> DataFrame:
    """One row per shared block: text, number of files, first file, position there.

    The blocks are cut out of the first files, which are joined once with the list of what to cut.
    """
    return _cut(files, block_sizes(files, options, scope), options, scope)


def _cut(files: DataFrame, sizes: DataFrame, options: Options, scope: str) -> DataFrame:
    wanted = sizes.groupBy("repo", F.col("first.path").alias("path")).agg(
        F.collect_list(F.struct("h", "h2", "n_files", F.col("first.idx").alias("idx"))).alias("wanted")
    )
    rows = _scoped(files, scope).select("repo", "path", "content", _value(options.block_size).alias("width"))
    one = rows.join(wanted, ["repo", "path"]).select("repo", "path", "width", _code_lines().alias("code"), "wanted").select(
        "repo", "path", "width", "code", F.explode("wanted").alias("w")
    )
    return one.select(
        "repo", "w.h", "w.h2", F.array_join(F.slice("code", F.col("w.idx"), F.col("width")), "\n").alias("block"),
        "w.n_files", F.col("path").alias("first_file"), F.col("w.idx").alias("first_idx"), F.col("width").alias("block_size"),
    )


def block_files(files: DataFrame, options: Options = DEFAULTS, scope: str = "repo") -> DataFrame:
    """Every (repo, block, path) whose block occurs in at least two files of the repo.

    Members are worked out once and stored as hashes; a block that very many files have is dealt over as many keys as
    it has thousands of files, and its text is copied to each.
    """
    members = durable(_block_members(files, options, scope))
    sizes = durable(_sizes(members, _BLOCK, 2))
    salts = F.ceil(F.col("n_files") / SPLIT)
    shared = _cut(files, sizes, options, scope).select(*_BLOCK, "block", "n_files")
    copies = shared.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    hot = sizes.filter(F.col("n_files") > SPLIT).select(*_BLOCK, salts.alias("salts"))
    salt = F.coalesce(F.pmod(F.xxhash64("path"), F.col("salts")), F.lit(0).cast("long"))
    dealt = members.join(hot, _BLOCK, "left").withColumn("salt", salt)
    return dealt.join(copies, [*_BLOCK, "salt"]).select("repo", "path", "idx", "block", "n_files")


def _label(first: Column, n_files: Column) -> Column:
    """The first file and how many more there are."""
    return F.concat(first, F.lit(", and "), n_files - 1, F.lit(" more"))


def duplicate_block_findings(files: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    found = item("REU1", block_size=F.col("block_size"), n=F.col("n_files"),
                 code_before=F.col("block"))
    label = _label(F.col("first_file"), F.col("n_files"))
    return finding_rows(duplicate_blocks(files, options), "REU1", "Reusability", 0, label,
                        found, F.col("first_file"), F.col("first_idx"))


_IMPORTS = ["repo", "h", "h2"]


def _import_members(files: DataFrame, options: Options) -> DataFrame:
    """(repo, h, h2, path, idx, imports, least) of files with import lines."""
    lines = F.array_sort(F.filter(
        F.transform(text.split_lines(F.col("content")), text.strip),
        lambda t: text.starts_with_any(t, ["import ", "from "]),
    ))
    with_imports = files.filter(text.contains_any(F.col("content"), ["import ", "from "]))
    with_imports = with_imports.withColumn("least", _value(options.import_repetition_threshold))
    joined = F.transform(F.array(lines), lambda a: F.when(F.size(a) > 0, F.array_join(a, "\n")))
    rows = text.explode_rows(with_imports, ["repo", "path", "least"], joined, "imports")
    return rows.select("repo", "path", "imports", "least", F.xxhash64("imports").alias("h"),
                       F.xxhash64(F.lit(1), "imports").alias("h2"), F.lit(0).alias("idx"))


def import_sets(files: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """One row per set that ``import_repetition_threshold`` files have: hashes, size, first file."""
    members = _import_members(files, options).drop("imports")
    return _sizes(members, [*_IMPORTS, "least"], F.col("least")).drop("least")


def import_set_files(files: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Every (repo, import set, path) whose set occurs in ``import_repetition_threshold`` files."""
    members = _import_members(files, options).drop("least")
    return members.join(import_sets(files, options).drop("first"), _IMPORTS).drop("h", "h2")


def repeated_import_findings(files: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    sets = import_sets(files, options)
    return finding_rows(sets, "REU2", "Reusability", 1, _label(F.col("first.path"), F.col("n_files")),
                        item("REU2", n=F.col("n_files")), F.col("first.path"))


def inline_logic(options: Options) -> Column:
    hits = F.filter(
        F.col("ln"), lambda x: (F.length(x["txt"]) > 120) & (text.count_of(x["raw"], "(") >= 3)
    )
    return gated(
        F.col("content").contains("("),
        F.transform(hits, lambda x: item("REU3", line=x["no"], n=F.length(x["txt"]))),
    )


FILE_CHECKS = [FileCheck("REU3", "Reusability", 2, 0, inline_logic)]
