"""Positions of rows in sorted order, without a window over raw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# monotonically_increasing_id: the partition above this many bits, the row below them.
ROW_BITS = 33


def sliced(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` sorted over range partitions and written, with ``slice`` and ``row`` (from 0) in that order.

    Rows that are equal in all of ``order`` go to one partition; put a column that tells
    rows apart last. ``df`` is read twice (once for the ranges), so it should be narrow or written.
    """
    at = F.monotonically_increasing_id()
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("slice", at), name)
    return rows.withColumn("row", F.col("slice").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).withColumn(
        "slice", F.shiftright("slice", ROW_BITS).cast("int"))


def numbered(df: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``position`` (from 0, by ``order``) in its ``tree`` and ``total``, the tree's rows.

    Trees are runs of the sorted table, so a partition holds few parts of them: only
    those are counted and summed up, one row per part, and no window sees raw rows.
    """
    rows = sliced(df, [tree, *order], name)
    parts = rows.groupBy(tree, "slice").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    of = Window.partitionBy(tree)
    before = F.sum("n").over(of.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    parts = written(parts.select(tree, "slice", "first", F.coalesce(before, F.lit(0)).alias("before"),
                                 F.sum("n").over(of).alias("total")), f"{name}-parts")
    return (rows.join(parts, [tree, "slice"])
            .withColumn("position", F.col("before") + F.col("row") - F.col("first"))
            .drop("slice", "row", "first", "before"))
