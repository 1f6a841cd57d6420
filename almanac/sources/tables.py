"""Parquet table access (S8) with explicit column lists so scans stay pruned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..session import SPREAD_KEY, table_path


def spread_small(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    """``df`` hash-partitioned on ``key`` where the session asks for it with
    ``spark.almanac.spread`` (a number of partitions): for CPU-heavy work on small tables
    in one file, whose scan is one task. Unset, as on a cluster with many splits,
    nothing is shuffled."""
    partitions = int(spark.conf.get(SPREAD_KEY, "0"))
    return df.repartition(partitions, key) if partitions else df


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: Sequence[str] | None = None, spread_on: str | None = None) -> DataFrame:
    """A pruned scan; ``spread_on`` names a key for :func:`spread_small`."""
    df = spark.read.parquet(table_path(sf_dir, name))
    df = df.select(*columns) if columns else df
    return spread_small(spark, df, spread_on) if spread_on else df
