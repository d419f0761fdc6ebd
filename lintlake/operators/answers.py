"""Answers of the external reviewer as tables: fences, JSON, verdicts, review findings, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions import text
from lintlake.operators.findings import finding_rows

VERDICTS = "array<struct<index:int,valid:boolean,reason:string,improved_suggestion:string>>"
REVIEWS = ("array<struct<file:string,severity:string,title:string,description:string,"
           "suggestion:string,line:int>>")
FIXES = "array<struct<finding_index:int,original:string,fixed:string,explanation:string>>"

_FENCE = "```"


def unfenced(answer: Column) -> Column:
    """Drop a Markdown fence: the first line and everything from the last fence. Null if one line."""


    def open_up(s: Column) -> Column:
        inner = F.regexp_replace(s, r"\A[^\n]*\n", "")
        inner = F.regexp_replace(inner, r"(?s)\A(.*)```.*\z", "$1")
        return F.when(~s.startswith(_FENCE), s).when(s.contains("\n"), inner)

    # A one-element array binds the stripped text once.
    return F.get(F.transform(F.array(text.strip(answer)), open_up), F.lit(0))


def entries(answer: Column) -> Column:
    """The entries of an answer's JSON array as variants; null if the answer is not one."""
    body = F.array(text.strip(unfenced(answer)))
    whole = lambda b: b.startswith("[") & b.endswith("]")
    read = lambda b: F.try_variant_get(F.try_parse_json(b), "$", "array<variant>")
    return F.get(F.transform(body, lambda b: F.when(whole(b), read(b))), F.lit(0))


def _truth(value: Column) -> Column:
    """A flag by its JSON value: null, false, zero and empty values are no; null where there is none."""
    kind, string = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    return (
        F.when(value.isNull(), F.lit(None).cast("boolean"))
        .when(F.is_variant_null(value), False)
        .when(kind == "STRING", string != "")
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~string.isin("[]", "{}"))
        .otherwise(F.try_variant_get(value, "$", "double") != 0)
    )


def _field(entry: Column, name: str, kind: str) -> Column:
    """One field of an entry: whole numbers and flags by the JSON type, anything else as text."""
    value = F.try_variant_get(entry, f"$.{name}", "variant")
    if kind == "boolean":
        return _truth(value)
    if kind == "int":
        return F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "int"))
    return F.try_variant_get(value, "$", kind)


def parsed(answer: Column, schema: str) -> Column:
    """The JSON array of an answer, null if it is not one.

    Every entry stands alone: one that is not an object is a null element, a field that is missing or of
    another type is a null field, and neither touches its neighbours.
    """
    fields = [f.split(":") for f in schema.removeprefix("array<struct<").removesuffix(">>").split(",")]
    return F.transform(
        entries(answer),
        lambda e: F.when(
            F.schema_of_variant(e).startswith("OBJECT"),
            F.struct(*[_field(e, name, kind).alias(name) for name, kind in fields]),
        ),
    )


def file_key(file: Column) -> Column:
    """Multi-file findings are handled under their first file."""
    return text.strip(F.get(F.split(file, ",", -1), F.lit(0)))


def indexed(findings: DataFrame) -> DataFrame:
    """Add the file key and the 1-based index of a finding inside its file.

    A group holds the findings of one file, whose size is bounded by the collection rules.
    """
    keyed = findings.withColumn("key", file_key(F.col("file")))
    order = Window.partitionBy("repo", "key").orderBy("ord")
    return keyed.withColumn("idx", F.row_number().over(order))


def with_file(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with their file's columns; null where the file is not in the table."""
    return findings.join(files.withColumnRenamed("path", "key"), ["repo", "key"], "left")


def validated(findings: DataFrame, files: DataFrame, responses: DataFrame) -> DataFrame:
    """Keep, rewrite or drop findings by the verdicts for their file.

    ``responses(repo, key, text)``. Files without text, without an answer or with an answer that is no JSON
    array keep their findings. Otherwise a finding stays only if a verdict names its index and does not
    call it invalid. An entry without an index is broken: the other verdicts hold, and as it may have been
    about any finding that no verdict names, those stay unchanged. Only sizes, not texts, take part in the
    join with the files.
    """
    verdicts = responses.select("repo", "key", parsed(F.col("text"), VERDICTS).alias("verdicts"))
    sizes = files.select("repo", F.col("path").alias("key"), "size")
    rows = indexed(findings).join(sizes, ["repo", "key"], "left").join(verdicts, ["repo", "key"], "left")
    named = F.exists("verdicts", lambda v: F.coalesce(v["index"] == F.col("idx"), F.lit(False)))
    broken = F.exists("verdicts", lambda v: v["index"].isNull())
    untouched = (F.coalesce("size", F.lit(0)) == 0) | F.col("verdicts").isNull() | (broken & ~named)
    original = F.struct("suggestion", "description")
    better = lambda v: F.when(
        F.coalesce(v["improved_suggestion"], F.lit("")) != "", v["improved_suggestion"]
    ).otherwise(F.col("suggestion"))
    confirmed = F.transform(
        F.filter(
            F.col("verdicts"),
            lambda v: (v["index"] == F.col("idx")) & F.coalesce(v["valid"], F.lit(True)),
        ),
        lambda v: F.struct(
            better(v).alias("suggestion"),
            F.concat("description", F.lit(" [AI: "), F.coalesce(v["reason"], F.lit("")), F.lit("]"))
            .alias("description"),
        ),
    )
    kept = F.when(untouched, F.array(original)).otherwise(confirmed)
    columns = [f"v.{c}" if c in ("suggestion", "description") else c for c in findings.columns]
    return text.explode_rows(rows, findings.columns, kept, "v").select(*columns)


def dismissal_counts(before: DataFrame, after: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per repo: findings before, dismissed, and findings added by the review."""
    tag = lambda df, name: df.select("repo", F.lit(name).alias("stage"))
    rows = tag(before, "before").unionByName(tag(after, "after")).unionByName(tag(reviews, "added"))
    n = lambda name: F.count_if(F.col("stage") == name)
    return rows.groupBy("repo").agg(
        n("before").alias("n_before"), (n("before") - n("after")).alias("n_dismissed"),
        n("added").alias("n_added"),
    )


def by_analyzer(findings: DataFrame) -> DataFrame:
    """Findings per analyzer and category, as regrouped after validation."""
    return findings.groupBy("repo", "analyzer", "category").agg(F.count(F.lit(1)).alias("n_findings"))


def review_findings(responses: DataFrame) -> DataFrame:
    """``responses(repo, text)`` of the whole-repo review -> findings with defaults filled in."""
    rows = responses.select(
        "repo", F.posexplode_outer(parsed(F.col("text"), REVIEWS)).alias("pos", "a")
    ).filter(F.col("a").isNotNull())
    default = lambda name, value: F.coalesce(F.col(f"a.{name}"), F.lit(value)).alias(name)
    found = F.struct(
        F.col("a.line").alias("line"), default("severity", "medium"), default("title", "AI Finding"),
        default("description", ""), default("suggestion", ""),
        F.lit(None).cast("string").alias("code_before"),
    )
    return finding_rows(rows, "AI", "AI Deep Review", 0, F.coalesce("a.file", F.lit("(unknown)")), found,
                        sub=F.col("pos"))
