"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm import common


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (x, y); a component is named by its smallest id.

    Each round points every vertex at its smallest neighbour, follows the pointers twice, and replaces the links by
    links between the targets. Pointers only go down, so they form trees, and every vertex that still has a link is
    merged with another one: the number of rounds is logarithmic. Only minima are aggregated, so a vertex with very
    many links costs one row per task.
    """
    edges = common.stored(links.filter("x <> y").select("x", "y").distinct(), links.count())
    n = edges.count()
    ids = edges.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    named = common.stored(ids.withColumn("component", F.col("id")), 2 * n)
    while n:
        both = edges.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e"))
        least = both.select("e.*").groupBy("x").agg(F.min("y").alias("y"))
        target = common.stored(least.select(F.col("x").alias("v"), F.least("x", "y").alias("t")), 2 * n)
        for _ in range(2):
            further = target.select(F.col("v").alias("t"), F.col("t").alias("further"))
            target = target.join(further, "t", "left").select("v", F.coalesce("further", "t").alias("t"))
        target = common.stored(target, 2 * n)
        named = common.stored(
            named.join(target, F.col("component") == F.col("v"), "left")
            .select("id", F.coalesce("t", "component").alias("component")), named.count()
        )
        x = target.select(F.col("v").alias("x"), F.col("t").alias("tx"))
        y = target.select(F.col("v").alias("y"), F.col("t").alias("ty"))
        edges = common.stored(
            edges.join(x, "x").join(y, "y").filter("tx <> ty")
            .select(F.least("tx", "ty").alias("x"), F.greatest("tx", "ty").alias("y")).distinct(), n
        )
        n = edges.count()
    return named
