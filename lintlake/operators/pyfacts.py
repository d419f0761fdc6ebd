"""Python syntax facts and the checks on them.

The only Python-worker code of the checks: ``mapInArrow`` parses each ``.py`` file with the standard
library and returns one row of facts per file (arrays of imports, names, functions ...). Everything
decided from the facts is a JVM expression on that row, so no check needs a shuffle.
"""

from __future__ import annotations

import ast
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions import text
from lintlake.functions.memo import per_application
from lintlake.functions.ranking import durable
from lintlake.operators.findings import ANALYZER_NO, CATEGORY, item

FACTS_SCHEMA = """
    repo string, path string, parsed boolean, too_deep boolean,
    imports array<struct<name:string,line:int>>,
    names array<string>,
    exports array<string>,
    guarded array<struct<lo:int,hi:int>>,
    funcs array<struct<name:string,class:string,line:int,end_line:int,is_async:boolean,
                       typed:boolean,decisions:int,source:string>>,
    mutable array<struct<name:string,line:int,kind:string>>
"""
_COLUMNS = ["repo", "path", "parsed", "too_deep", "imports", "names", "exports", "guarded", "funcs", "mutable"]
_BRANCHES = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With,
             ast.AsyncWith, ast.Assert)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_BATCH_ROWS = 64
#: A worker keeps the facts of this many short texts, those it met last: copied files are parsed once.
_KEPT_TEXTS, _SHORT = 512, 4_096


def _list(**fields: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct(fields.items()))


#: FACTS_SCHEMA for Arrow, which turns the parser's plain values into columns as they are.
_ARROW = pa.schema([
    ("repo", pa.string()), ("path", pa.string()), ("parsed", pa.bool_()), ("too_deep", pa.bool_()),
    ("imports", _list(name=pa.string(), line=pa.int32())),
    ("names", pa.list_(pa.string())),
    ("exports", pa.list_(pa.string())),
    ("guarded", _list(lo=pa.int32(), hi=pa.int32())),
    ("funcs", _list(**{"name": pa.string(), "class": pa.string(), "line": pa.int32(), "end_line": pa.int32(), "is_async": pa.bool_(),
                       "typed": pa.bool_(), "decisions": pa.int32(), "source": pa.string()})),
    ("mutable", _list(name=pa.string(), line=pa.int32(), kind=pa.string())),
])


def syntax_facts(files: DataFrame, with_source: bool = False) -> DataFrame:
    """One facts row per ``.py`` file."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _BATCH_ROWS):
                repos, paths, contents = (c.to_pylist() for c in batch.slice(start, _BATCH_ROWS).columns)
                facts = zip(*(_facts_once(content, with_source) for content in contents), strict=True)
                columns = zip([repos, paths, *facts], _ARROW.types, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], schema=_ARROW)

    python_files = files.filter(F.col("path").endswith(".py")).select("repo", "path", "content")
    return python_files.mapInArrow(extract, FACTS_SCHEMA)


def remembered_facts(files: DataFrame, folder: str, with_source: bool = False) -> DataFrame:
    """``syntax_facts`` by way of a table of facts in ``folder``, named by the texts' md5.

    Each distinct text is parsed once, whatever number of files and runs hold it: texts whose key is not in the table
    yet are parsed and appended, then all files take their facts from it. Keys are found from narrow rows; only
    the new texts are read again. Runs side by side may both append a key, so a key counts once when read.
    """
    spark, place = files.sparkSession, f"{folder}/{'with_source' if with_source else 'plain'}"
    schema = FACTS_SCHEMA.replace("repo string, path string", "key string")
    python_files = files.filter(F.col("path").endswith(".py")).select("repo", "path", "content", F.md5("content").alias("key"))
    first = python_files.groupBy("key").agg(F.min(F.struct("repo", "path")).alias("at"))
    try:
        first = first.join(spark.read.schema(schema).parquet(place), "key", "left_anti")
    except AnalysisException:  # no table yet
        pass
    new = durable(first.select("key", "at.repo", "at.path"))
    if not new.isEmpty():
        texts = python_files.join(new, ["repo", "path", "key"]).select(F.col("key").alias("repo"), "path", "content")
        parsed = syntax_facts(texts, with_source).withColumnRenamed("repo", "key").drop("path")
        parsed.write.mode("append").parquet(place)
    elif python_files.isEmpty():
        return syntax_facts(python_files, with_source)
    known = spark.read.schema(schema).parquet(place).dropDuplicates(["key"])
    return python_files.select("repo", "path", "key").join(known, "key").select(*_COLUMNS)


@lru_cache(_KEPT_TEXTS)
def _facts_of_short(content: str, with_source: bool) -> tuple:
    return _facts_of(content, with_source)


def _facts_once(content: str, with_source: bool) -> tuple:
    """``_facts_of``, remembered for short texts; nothing may change what it returns."""
    return (_facts_of_short if len(content) <= _SHORT else _facts_of)(content, with_source)


def _facts_of(content: str, with_source: bool) -> tuple:
    """Flatten one syntax tree, breadth first, into lists of plain facts."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return (False, False, [], [], [], [], [], [])
    except RecursionError:
        return (False, True, [], [], [], [], [], [])
    except MemoryError as error:  # the parser's own nesting limit says so; real shortage has no text
        if "stack" not in str(error).lower():
            raise
        return (False, True, [], [], [], [], [], [])
    lines = content.split("\n") if with_source else []
    imports, names, exports, guarded, funcs, mutable = [], {}, [], [], [], []
    queue = deque([(tree, None, ())])
    while queue:
        node, owner, inside = queue.popleft()
        weight = len(node.values) - 1 if isinstance(node, ast.BoolOp) else isinstance(node, _BRANCHES)
        if isinstance(node, _FUNCTIONS):
            source = "\n".join(lines[node.lineno - 1:node.end_lineno]) if with_source else None
            facts = {"name": node.name, "class": owner, "line": node.lineno, "end_line": node.end_lineno,
                     "is_async": isinstance(node, ast.AsyncFunctionDef),
                     "typed": node.returns is not None, "decisions": 0, "source": source}
            funcs.append(facts)
            inside = (*inside, facts)
            mutable += [{"name": node.name, "line": node.lineno, "kind": type(d).__name__.lower()}
                        for d in [*node.args.defaults, *node.args.kw_defaults]
                        if isinstance(d, (ast.List, ast.Dict, ast.Set))]
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            imports += [{"name": a.asname or a.name, "line": node.lineno} for a in node.names
                        if isinstance(node, ast.Import) or a.name != "*"]
        elif isinstance(node, ast.Name):
            names[node.id] = None
        elif isinstance(node, ast.If) and "TYPE_CHECKING" in (
                getattr(node.test, "id", None), getattr(node.test, "attr", None)):
            last = max(getattr(n, "lineno", node.lineno) for n in ast.walk(node))
            guarded.append({"lo": node.lineno, "hi": last})
        for facts in inside:
            facts["decisions"] += int(weight)
        owner = node.name if isinstance(node, ast.ClassDef) else None
        queue.extend((child, owner, inside) for child in ast.iter_child_nodes(node))
    for node in tree.body:
        if isinstance(node, ast.Assign) and isinstance(node.value, (ast.List, ast.Tuple, ast.Set)):
            if any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets):
                exports += [e.value for e in node.value.elts
                            if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    return (True, False, imports, list(names), exports, guarded, funcs, mutable)


# --- checks on one facts row ------------------------------------------------------------------


def _unguarded_imports() -> Column:
    """Imports outside every TYPE_CHECKING range (a range condition inside one file's row)."""
    return F.filter(
        F.col("imports"),
        lambda i: ~F.exists(
            F.col("guarded"), lambda g: (i["line"] >= g["lo"]) & (i["line"] <= g["hi"])
        ),
    )


def unused_imports() -> Column:
    """Last binding of each name decides the line; first binding decides the order."""
    used = F.array_union(F.col("names"), F.col("exports"))

    def of(imports: Column) -> Column:
        bound = F.array_distinct(F.transform(imports, lambda i: i["name"]))
        unused = F.array_except(bound, used)
        return F.transform(
            unused,
            lambda n: item(
                "AST1",
                line=F.element_at(F.filter(imports, lambda i: i["name"] == n), -1)["line"],
                name=n,
            ),
        )

    return F.flatten(F.transform(F.array(_unguarded_imports()), of))


def _over(n: Column, medium: int, high: int) -> Column:
    return F.when(n > high, "high").when(n > medium, "medium")


def complexity() -> Column:
    value = lambda f: f["decisions"] + F.lit(1)
    return F.transform(
        F.filter(F.col("funcs"), lambda f: value(f) > 10),
        lambda f: item("AST2", line=f["line"], severity=_over(value(f), 10, 20), name=f["name"],
                       n=value(f)),
    )


def function_length() -> Column:
    value = lambda f: f["end_line"] - f["line"] + F.lit(1)
    return F.transform(
        F.filter(F.col("funcs"), lambda f: value(f) > 50),
        lambda f: item("AST3", line=f["line"], severity=_over(value(f), 50, 100), name=f["name"],
                       n=value(f), end=f["end_line"]),
    )


def missing_return_types() -> Column:
    return F.transform(
        F.filter(F.col("funcs"), lambda f: ~f["name"].startswith("_") & ~f["typed"]),
        lambda f: item("AST4", line=f["line"], name=f["name"]),
    )


def mutable_defaults() -> Column:
    return F.transform(
        F.col("mutable"),
        lambda m: item("AST5", line=m["line"], name=m["name"], kind=m["kind"]),
    )


FACT_CHECKS = [
    ("AST1", unused_imports),
    ("AST2", complexity),
    ("AST3", function_length),
    ("AST4", missing_return_types),
    ("AST5", mutable_defaults),
]


_ANALYZER = "AST Analysis"


@per_application
def _tagged(check_id: str, order: int) -> Column:
    return F.transform(dict(FACT_CHECKS)[check_id](), lambda f, i: F.struct(
        F.lit(check_id).alias("check_id"),
        f.alias("f"),
        F.struct(
            F.lit(ANALYZER_NO[_ANALYZER]).alias("analyzer"),
            F.lit(0).alias("phase"),
            F.col("path").alias("path"),
            F.lit(order).alias("check"),
            i.alias("sub"),
        ).alias("ord"),
    ))


def fact_findings(facts: DataFrame, check_ids: list[str] | None = None) -> DataFrame:
    """Findings of the syntax checks from the facts table: one projection, one explode."""
    arrays = [_tagged(check_id, order) for order, (check_id, _) in enumerate(FACT_CHECKS)
              if check_ids is None or check_id in check_ids]
    found = text.explode_rows(facts.filter("parsed"), ["repo", "path"], F.concat(*arrays), "x")
    return found.select(
        "repo", F.lit(_ANALYZER).alias("analyzer"), F.lit(CATEGORY[_ANALYZER]).alias("category"),
        "x.check_id", F.col("path").alias("file"), "x.f.severity", "x.f.title", "x.f.description",
        "x.f.suggestion", "x.f.line", "x.f.code_before",
        F.lit(None).cast("string").alias("code_after"), "x.ord",
    )


def syntax_notes(facts: DataFrame) -> DataFrame:
    return facts.filter(~F.col("parsed")).select(
        "repo", F.lit("AST Analysis").alias("analyzer"), "path", F.lit(0).alias("sub"),
        F.when(F.col("too_deep"), text.fill(fv.NOTE_TOO_DEEP, path=F.col("path")))
        .otherwise(text.fill(fv.NOTE_SYNTAX, path=F.col("path"))).alias("note"),
    )


# --- functions to write tests for ------------------------------------------------------------


def public_functions(files: DataFrame) -> DataFrame:
    """Public functions with their source, in breadth-first order."""
    return (
        syntax_facts(files, with_source=True)
        .select("repo", "path", F.posexplode("funcs").alias("seq", "f"))
        .select("repo", "path", "seq", "f.name", "f.class", "f.line", "f.end_line", "f.source", "f.is_async")
        .filter(~F.col("name").startswith("_"))
    )
