"""Vector expressions over ``array<float|double>`` columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_vector(values) -> Column:
    """A query vector as a literal ``array<double>`` (or pass a Column through)."""
    if isinstance(values, Column):
        return values
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def dot(a, b) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a) -> Column:
    squares = F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0).cast("double"), lambda acc, x: acc + x))


def cosine(a, b) -> Column:
    """Cosine similarity in double precision; NULL (not NaN) for a zero vector
    or a length mismatch (T11). ``b`` may be a list of numbers, whose norm is then
    computed here and not per row."""
    a = _c(a)
    if isinstance(b, (Column, str)):
        b = _c(b)
        return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))
    squares = 0.0
    for x in b:
        squares += float(x) * float(x)
    denom = norm(a) * F.lit(math.sqrt(squares))
    return F.when(F.size(a) == len(b), F.try_divide(dot(a, as_vector(b)), denom))


def unit(a) -> Column:
    """Scale a vector to unit length (NULL for the zero vector)."""
    n = norm(a)
    return F.when(n != 0, F.transform(_c(a), lambda x: x.cast("double") / n))


def fixed_dim(a, dim: int) -> Column:
    """The ``FLOAT[dim]`` check the storage type implied."""
    return F.size(_c(a)) == dim
