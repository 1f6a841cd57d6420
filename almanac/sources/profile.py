"""Dataset profile (S10, S11, A1): rows and nulls per column in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def profile(df: DataFrame, name: str, approx_distinct: bool = False) -> DataFrame:
    """One aggregate job over ``df``; one output row per column:
    (table, column, data_type, rows, nulls[, approx_distinct])."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(df.schema.fields):
        aggs.append(F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"_n{i}"))
        if approx_distinct:
            aggs.append(F.approx_count_distinct(F.col(f"`{f.name}`")).alias(f"_d{i}"))
    one = df.agg(*aggs)
    entries = []
    for i, f in enumerate(df.schema.fields):
        fields = [F.lit(name).alias("table"), F.lit(f.name).alias("column"),
                  F.lit(f.dataType.simpleString()).alias("data_type"),
                  F.col("_rows").alias("rows"), F.col(f"_n{i}").alias("nulls")]
        if approx_distinct:
            fields.append(F.col(f"_d{i}").alias("approx_distinct"))
        entries.append(F.struct(*fields))
    return one.select(F.inline(F.array(*entries)))


def profile_tables(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> DataFrame:
    from .tables import read_table
    out = None
    for n in names:
        p = profile(read_table(spark, sf_dir, n), n)
        out = p if out is None else out.unionByName(p)
    return out


def peek(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows in an explicit order (testable, unlike a bare LIMIT)."""
    return df.orderBy(*order).limit(n)
