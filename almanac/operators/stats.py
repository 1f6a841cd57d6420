"""Counts, distinct lists, top-k and per-group heads.

All aggregations are plain ``groupBy``/``agg`` (partial + final aggregation,
so a hot key is combined map-side); top-k uses ``orderBy().limit()`` which
Spark plans as TakeOrderedAndProject; per-group heads use ``row_number() <= n``
which becomes a partial WindowGroupLimit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import not_blank


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def count_rows(df: DataFrame, alias: str = "n") -> DataFrame:
    """A1 / A2 (after a filter): one row with the count."""
    return df.agg(F.count(F.lit(1)).alias(alias))


def top_counts(df: DataFrame, key, k: int | None = 5, alias: str = "cnt",
               key_name: str | None = None) -> DataFrame:
    """A3: group count, most frequent first (ties by key), optionally top k."""
    key_col = _c(key) if key_name is None else _c(key).alias(key_name)
    name = key_name or (key if isinstance(key, str) else None)
    out = df.groupBy(key_col).agg(F.count(F.lit(1)).alias(alias))
    kname = name or out.columns[0]
    out = out.orderBy(F.desc(alias), F.asc_nulls_last(kname))
    return out.limit(k) if k else out


def explode_list(df: DataFrame, col: str, name: str, *keep: str) -> DataFrame:
    """Rows of ``keep`` columns with one list element each (NULL elements dropped).

    ``explode_outer`` plus a filter on the generated column, rather than
    ``explode``: a plain explode lets Spark infer ``size(list) > 0`` and push it
    below earlier operators, which re-evaluates an expensive list expression.
    """
    out = df.select(*keep, F.explode_outer(_c(col)).alias(name))
    return out.filter(F.col(name).isNotNull())


def tag_counts(df: DataFrame, tags: str = "tags", k: int | None = 5,
               tag_name: str = "tag", alias: str = "count") -> DataFrame:
    """A4: explode a list column and count each element (top k)."""
    return top_counts(explode_list(df, tags, tag_name), tag_name, k, alias)


def distinct_sorted(df: DataFrame, expr, name: str) -> DataFrame:
    """A5 + P14 + L1: distinct non-blank values of an expression, ascending."""
    vals = df.select(_c(expr).alias(name)).filter(not_blank(name)).distinct()
    return vals.orderBy(F.asc_nulls_last(name))


def distinct_elements(df: DataFrame, tags: str, name: str = "tag") -> DataFrame:
    """Distinct elements of a list column, ascending, blanks dropped."""
    return distinct_sorted(explode_list(df, tags, name), name, name)


def exists_flag(df: DataFrame, cond: Column, by: Sequence[str], name: str = "found") -> DataFrame:
    """Per group, whether any row satisfies ``cond``."""
    return df.groupBy(*by).agg(F.bool_or(cond).alias(name))


def latest(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows of an explicit total order."""
    return df.orderBy(*order).limit(n)


def head_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int,
                   rank_name: str = "rn") -> DataFrame:
    """The first ``n`` rows of each group (WindowGroupLimit)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(w)).filter(F.col(rank_name) <= n)


def count_by(df: DataFrame, keys: Sequence[str], alias: str = "cnt") -> DataFrame:
    """Group count over several keys (used for tag-by-year, category-by-month)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))
