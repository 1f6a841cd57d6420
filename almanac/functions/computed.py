"""Compute expensive columns once.

Catalyst inlines a projected expression into every filter pushed below it and
every projection collapsed into it. For cheap expressions that is free; for
whole-text regexes and higher-order functions over long arrays it means the
same work several times per row. Producing the columns through a one-element
``inline`` generator keeps them as real attributes: predicates on them stay
above the generator, and the expression is evaluated once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, **cols: Column) -> DataFrame:
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
