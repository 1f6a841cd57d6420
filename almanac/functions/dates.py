"""Date functions (F10-F12). ANSI mode is on, so every parse is a ``try_``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_ymd(col) -> Column:
    """``strptime(s, '%Y-%m-%d')``; NULL where it would raise."""
    return F.try_to_date(_c(col), "yyyy-MM-dd")


def move_to_year(date_col, year_col) -> Column:
    """``d.replace(year=y)``; NULL where that raises (29 February)."""
    y = _c(year_col).cast("int")
    return F.try_to_date(
        F.format_string("%04d-%s", y, F.date_format(_c(date_col), "MM-dd")),
        "yyyy-MM-dd")


def day_distance(a, b) -> Column:
    """absolute day difference."""
    return F.abs(F.datediff(_c(a), _c(b)))
