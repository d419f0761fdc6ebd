"""Document fingerprints from closed syncmers, with DataFrame expressions only.

The letters are the words of a text, with ``K - 1`` end marks before and after it; a word of more than ``LONG`` characters
is taken character by character, so a text without spaces has letters too. A run of ``K`` letters is an anchor where
its smallest letter, by hash, is its first or its last one. That depends on the run alone, so the same passage
has the same anchors in every document. All anchors of a text with their positions are the result, and similarities are
those of the whole anchor sets. A fingerprint is a digest of them: the ``SKETCH`` smallest hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm import common

K = 3
SKETCH = 128
#: Characters of a word, at most; a longer one is no word of a language with spaces.
LONG = 32
_MARK = 2**63 - 1


def with_anchors(rows: DataFrame, body: str, name: str, k: int = K) -> DataFrame:
    """Add ``name``: array of (pos, hash), the position of each anchor's first letter (marks are before 0).

    Hashes have 31 bits.
    """
    words = F.filter(F.split(body, r"\s+", -1), lambda w: w != "")
    cut = rows.withColumn("_words", words)
    characters = lambda w: F.when(F.length(w) > LONG, F.filter(F.split(w, ""), lambda c: c != "")).otherwise(F.array(w))
    letters = F.when(F.exists("_words", lambda w: F.length(w) > LONG), F.flatten(F.transform("_words", characters))).otherwise(F.col("_words"))
    hashed = cut.withColumn("_hashes", F.transform(letters, lambda w: F.xxhash64(w))).drop("_words")
    marks = F.array(*[F.lit(_MARK)] * (k - 1))
    marked = hashed.withColumn("_letters", F.concat(marks, "_hashes", marks))
    p = F.col("_letters")

    def closed(_: Column, i: Column) -> Column:
        return F.least(p[i], p[i + (k - 1)]) <= (F.least(*[p[i + j] for j in range(1, k - 1)]) if k > 3 else p[i + 1])

    starts = F.filter(F.sequence(F.lit(0), F.size(p) - F.lit(k)), lambda i: closed(i, i))
    anchor = F.transform(
        starts, lambda i: F.struct((i - F.lit(k - 1)).alias("pos"), F.shiftrightunsigned(F.xxhash64(*[p[i + j] for j in range(k)]), 33).cast("int").alias("hash"))
    )
    none = F.array().cast("array<struct<pos:int,hash:int>>")
    return marked.withColumn(name, F.when(F.size("_hashes") > 0, anchor).otherwise(none)).drop("_hashes", "_letters")


def sketch(anchors: str) -> Column:
    """The smallest distinct anchor hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(F.col(anchors)["hash"])), 1, SKETCH)


def likeness(a: str, b: str) -> Column:
    """Similarity of two anchor arrays, 0 to 1, by all their distinct hashes; two empty ones are alike."""
    x, y = F.col(a)["hash"], F.col(b)["hash"]
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def placed(a: str, b: str) -> Column:
    """The number of anchors that two anchor arrays have at the same position."""
    packed = lambda c: F.transform(c, lambda x: F.shiftleft(x["pos"].cast("long"), 31).bitwiseOR(x["hash"].cast("long")))
    return F.size(F.array_intersect(packed(a), packed(b)))


def as_text(values: str) -> Column:
    """Eight hexadecimal digits for each value."""
    return F.lower(F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def _documents(documents: DataFrame) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return documents.select(F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("id"), F.xxhash64(body).alias("h"), body.alias("body"))


def in_order(rows: DataFrame) -> DataFrame:
    """Each distinct (id, h) with its predecessor and successor in that order, the ends joined to a ring.

    Rows are range-partitioned and stored; inside a part neighbours come from a window, across parts from a table
    with one row per part.
    """
    ranged = common.stored(rows.repartitionByRange("id", "h").withColumn("part", F.spark_partition_id()))
    key = F.struct("id", "h", "n")
    ends = ranged.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    ring = Window.orderBy("part")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lag("last").over(ring), F.last("last").over(whole)).alias("part_before"),
        F.coalesce(F.lead("first").over(ring), F.first("first").over(whole)).alias("part_after"),
    )
    inside = Window.partitionBy("part").orderBy("id", "h")
    near = ranged.select("*", F.lag(key).over(inside).alias("before"), F.lead(key).over(inside).alias("after"))
    return near.join(ends, "part").select(
        "id", "h", F.coalesce("before", "part_before").alias("before"), F.coalesce("after", "part_after").alias("after")
    )


def edited_likeness(documents: DataFrame) -> DataFrame:
    """Anchors of every text and of its edited text, their digests, both likenesses, anchors at the same place.

    The edited text has its last quarter of characters replaced by the first ones of the next document. Order is by
    doc_id (null last), texts that share an id by their hash; rows that repeat id and text are one document and get the
    same result each. A null text counts as empty; a single document is its own successor. Texts are shuffled
    by id, once more to their predecessor, and anchors are worked out there rather than moved.
    """
    rows = _documents(documents)
    order = common.stored(in_order(rows.select("id", "h", F.length("body").alias("n")).distinct()))
    before = order.select("id", "h", F.col("before.id").alias("p_id"), F.col("before.h").alias("p_h"))
    following = (
        rows.join(before, ["id", "h"]).select(F.col("p_id").alias("id"), F.col("p_h").alias("h"), F.col("body").alias("following"))
        .groupBy("id", "h").agg(F.max("following").alias("following"))
    )
    n = F.length("body")
    edited = rows.join(following, ["id", "h"]).select(
        "id", "body", "following", n.cast("long").alias("n_chars"),
        F.concat(F.left("body", n - F.floor(n / 4)), F.left("following", F.floor(n / 4))).alias("edited"),
    )
    own = with_anchors(edited, "body", "anchors").drop("body")
    both = with_anchors(own, "edited", "edited_anchors")
    both = both.select("id", "n_chars", "following", F.sha2("edited", 256).alias("edited_sha256"), "anchors", "edited_anchors")
    three = with_anchors(both, "following", "next_anchors").drop("following")
    digests = three.withColumn("print", sketch("anchors")).withColumn("edited_print", sketch("edited_anchors"))
    return digests.select(
        F.when(F.col("id") != common.NULL_ID, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256",
        as_text("print").alias("fingerprint"), as_text("edited_print").alias("edited_fingerprint"),
        likeness("anchors", "edited_anchors").alias("near_edited"), likeness("anchors", "next_anchors").alias("near_next"),
        placed("anchors", "edited_anchors").cast("long").alias("n_placed_edited"),
        placed("anchors", "next_anchors").cast("long").alias("n_placed_next"), "anchors", "edited_anchors",
    )
