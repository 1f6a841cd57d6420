"""Markdown lines -> week entries with a category map (W1, A7, A8, T-D, L8, F24).

The original walks lines and carries the current week/category forward. Here
each file is cut at header lines inside its row (the carry-forward becomes
"which section is this line in"), body lines are stripped and joined inside
the row, and only then is there one shuffle: grouping (file, week, category).
Groups are bounded by what ends up in one output value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.computed import with_computed
from ..functions.text import WS_INLINE, py_strip
from ..sources.markdown import DATE, HEADER_LINE
from .tags import CATEGORY_MAP, SKIP_CATEGORY, categorize

# A section starts at a line that, once stripped, is a header line.
_HEADER_START = rf"(?md)^(?={WS_INLINE}*#{WS_INLINE}*\[{DATE}~{DATE}\])"


def week_sections(files: DataFrame, category_map: Mapping[str, Sequence[str]] = CATEGORY_MAP,
                  skip_toc: bool = True) -> DataFrame:
    """(file, text) -> one row per header section with its category and
    its stripped, non-empty body lines joined by newlines.

    Lines before the first header are ignored; a table-of-contents header
    (``skip_toc``) drops its section.
    """
    chunks = files.select("file", F.posexplode(F.split("text", _HEADER_START, -1))
                          .alias("pos", "chunk"))
    chunks = with_computed(chunks, _first=py_strip(F.substring_index("chunk", "\n", 1)))
    chunks = chunks.filter(F.col("_first").rlike(HEADER_LINE))
    body_lines = F.filter(
        F.transform(F.slice(F.split("chunk", "\n", -1), 2, 1 << 30), py_strip),
        lambda x: x != "")
    chunks = with_computed(
        chunks, week_range=F.regexp_extract("_first", HEADER_LINE, 1),
        _title=F.regexp_extract("_first", "(?s)" + HEADER_LINE, 2),
        body=F.array_join(body_lines, "\n"))
    out = chunks.select("file", "pos", "week_range",
                        categorize("_title", category_map, skip_toc=skip_toc).alias("category"),
                        "body")
    return out.filter((F.col("category") != SKIP_CATEGORY) & (F.col("body") != ""))


def week_category_texts(sections: DataFrame, per_file: bool = True) -> DataFrame:
    """One row per (file, week, category): the body lines in file order.

    ``per_file=False`` merges the same week across files (ordered by file
    name, then position), which is what a range-partitioned archive needs.
    """
    keys = ["file", "week_range", "category"] if per_file else ["week_range", "category"]
    ordered = F.array_sort(F.collect_list(F.struct("file", "pos", "body")))
    return (sections.groupBy(*keys)
            .agg(F.array_join(F.transform(ordered, lambda s: s["body"]), "\n").alias("content"),
                 F.min(F.struct("file", "pos")).alias("_first")))


def to_weeks(sections: DataFrame, per_file: bool = True, sort: bool = True) -> DataFrame:
    """A8 + L8: week entries ``(id, year, month, week_range, content map)``,
    categories in first-appearance order, sorted by id (``sort=False`` skips
    the global sort when the order is not needed)."""
    texts = week_category_texts(sections, per_file)
    keys = ["file", "week_range"] if per_file else ["week_range"]
    entries = F.array_sort(F.collect_list(F.struct("_first", "category", "content")))
    weeks = texts.groupBy(*keys).agg(F.map_from_entries(
        F.transform(entries, lambda e: F.struct(e["category"], e["content"]))).alias("content"))
    start = F.split_part("week_range", F.lit("~"), F.lit(1))
    cols = [F.col("week_range").alias("id"), F.substring(start, 1, 4).alias("year"),
            F.substring(start, 6, 2).cast("int").alias("month"), "week_range", "content"]
    if per_file:
        cols.append("file")
    out = weeks.select(*cols)
    if not sort:
        return out
    return out.orderBy("id", "file") if per_file else out.orderBy("id")


def flatten_weeks(weeks: DataFrame) -> DataFrame:
    """T-D: one row per (week, category) with the ``_``-separated id."""
    return weeks.select(F.replace("id", F.lit("~"), F.lit("_")).alias("id"), "year", "month",
                        F.explode("content").alias("category", "content"))


def flat_week_rows(sections: DataFrame, per_file: bool = True) -> DataFrame:
    """T-D straight from the sections: the same rows as
    ``flatten_weeks(to_weeks(sections))`` with one aggregation instead of two
    (the per-week map is never built)."""
    texts = week_category_texts(sections, per_file)
    start = F.split_part("week_range", F.lit("~"), F.lit(1))
    return texts.select(F.replace("week_range", F.lit("~"), F.lit("_")).alias("id"),
                        F.substring(start, 1, 4).alias("year"),
                        F.substring(start, 6, 2).cast("int").alias("month"),
                        "category", "content")


def weeks_json(weeks: DataFrame) -> DataFrame:
    """each week entry as one JSON object string (map order preserved)."""
    return weeks.select(F.to_json(F.struct("id", "year", "month", "week_range", "content"))
                        .alias("json"))
