"""Row numbers inside groups that may be too large for one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``.

    Only a local session, whose driver is its one executor, makes a folder of its own where that is unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lintlake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    folder = shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def _ranged(df: DataFrame, group: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Rows range-partitioned by (group, order) with their partition in ``_part``.

    A large group spreads over many partitions. The rows are checkpointed because the range bounds are
    sampled and all uses must agree.
    """
    bounds = [*group, *order] if parts is None else [parts, *group, *order]
    return durable(df.repartitionByRange(*bounds).withColumn("_part", F.spark_partition_id()))


def _earlier_parts(ranged: DataFrame, group: list[str], amount: Column) -> DataFrame:
    """Per (group, partition): the aggregate of the group's rows in earlier partitions, as ``_before``."""
    sizes = ranged.groupBy(*group, "_part").agg(amount.alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*group, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))


def _with_before(ranged: DataFrame, offsets: DataFrame, group: list[str]) -> DataFrame:
    """Add ``_before`` of the row's group and partition; a null group is a group like others."""
    keys = [*group, "_part"]
    there = offsets.withColumnsRenamed({c: f"_of_{c}" for c in keys})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    return ranged.join(there, same).drop(*[f"_of_{c}" for c in keys])


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``row_number()`` over (group, order) without sending a whole group to one task.

    Number = rows of the group in earlier partitions + position inside the partition.
    """
    ranged = _ranged(df, group, order)
    offsets = _earlier_parts(ranged, group, F.count(F.lit(1)))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    return (
        _with_before(ranged.withColumn("_pos", F.row_number().over(inside)), offsets, group)
        .withColumn(name, F.col("_before") + F.col("_pos"))
        .drop("_part", "_pos", "_before")
    )


def within_budget(
    df: DataFrame, group: list[str], order: list[str], amount: str, name: str, budget: int, parts: int | None = None
) -> DataFrame:
    """Rows whose earlier rows, by (group, order), add up to at most ``budget``; that sum is column ``name``.

    Amounts are not negative, so partitions that start beyond the budget are left out before their rows are
    sorted: of a large group only the first ones are read on. Rows of equal order have no defined sequence.
    """
    ranged = _ranged(df, group, order, parts)
    offsets = _earlier_parts(ranged, group, F.sum(amount)).filter(F.col("_before") <= budget)
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        _with_before(ranged, offsets, group)
        .withColumn(name, F.col("_before") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .filter(F.col(name) <= budget)
        .drop("_part", "_before")
    )
