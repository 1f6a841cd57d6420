"""Pipe-table row helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, py_strip


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def has_alnum(col) -> Column:
    """``any(c.isalnum() for c in s)``."""
    return _c(col).rlike(r"[\p{L}\p{N}]")


def cells_nonempty(line) -> Column:
    """split on ``|``, strip each cell, drop empty cells."""
    parts = F.transform(F.split(_c(line), r"\|", -1), py_strip)
    return F.filter(parts, lambda x: x != "")


def cells_kept(line) -> Column:
    """dot leaders and repeated pipes removed, outer pipes dropped,
    inner empty cells kept, trailing empty cells removed."""
    s = py_strip(line)
    s = F.replace(s, F.lit("···"), F.lit(""))
    s = F.replace(s, F.lit("..."), F.lit(""))
    s = F.regexp_replace(s, r"\|+", "|")
    s = F.regexp_replace(s, r"^\|+|\|+\z", "")
    # Everything after the last non-blank, non-pipe character is empty cells.
    s = F.regexp_replace(s, rf"(?:{WS}|\|)+\z", "")
    return F.when(s == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(s, r"\|", -1), py_strip))
