"""Number extraction from table cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rule's patterns, kept as written.
PAREN_GROUP = r"(?d)\(.*?\)"
NUMBER = r"([-+]?\d*\.\d+|\d+)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def extract_numbers(col, mode: str = "reference") -> Column:
    """All numbers of a cell after dropping parenthesised parts, as doubles.

    ``mode='reference'`` keeps the rule's quirks (T21): an integer loses its
    sign (``-5`` -> 5) and ``1,234.5`` reads as 1 and 234.5. ``mode='signed'``
    also accepts a sign in front of integers.
    """
    pattern = NUMBER if mode == "reference" else r"([-+]?(?:\d*\.\d+|\d+))"
    pure = F.regexp_replace(_c(col), PAREN_GROUP, "")
    return F.transform(F.regexp_extract_all(pure, F.lit(pattern), 1),
                       lambda s: s.cast("double"))


def number_mean(col, mode: str = "reference") -> Column:
    """Mean of the numbers in a cell; NULL when there is none (or the cell is NULL).

    One ``aggregate`` with a finishing step, so the extraction runs once."""
    zero = F.struct(F.lit(0.0).cast("double").alias("s"), F.lit(0).alias("n"))
    return F.aggregate(
        extract_numbers(col, mode), zero,
        lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["n"] + 1).alias("n")),
        lambda acc: F.when(acc["n"] > 0, acc["s"] / acc["n"]))
