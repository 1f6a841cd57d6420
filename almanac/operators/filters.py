"""Row predicates (P1-P21) as boolean Columns, plus the tiered fallback match.

Each rule is a column expression, so Catalyst can combine, reorder and push
it; none of them needs Python at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_removed
from .tags import TOC_MARKERS

# Markers the header-only rules look for, and reason labels.
HEADING_MARK = "###"
CHAPTER_CHARS = ("제", "장")
REASON_TOC = "MOKCHA FILTER"
REASON_HEADER = "HEADER FILTER"
REASON_SUMMARY = "NON-MATCH SUMMARY"

HEADER_RULES = ("logic", "v2", "briefing", "briefing_v2")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def contains_any(col, words: Sequence[str]) -> Column:
    cond = None
    for w in words:
        c = F.instr(_c(col), w) > 0
        cond = c if cond is None else (cond | c)
    return cond if cond is not None else F.lit(False)


def is_toc(col) -> Column:
    """A table-of-contents row (either spelling)."""
    return contains_any(col, TOC_MARKERS)


def clean_length(content) -> Column:
    """Length of the content with newlines, pipes and hyphens removed, stripped."""
    return F.length(strip_removed(content, "\n|-"))


def header_only(content, rule: str = "briefing_v2") -> Column:
    """True when the content is only a heading (the row is dropped).

    Let c = cleaned length, H = has ``###``, J = has both 제 and 장:
    logic: c<30 & H; v2: c<40 & H & (J | c<20); briefing: c<40 & H & (J | c<15);
    briefing_v2: H & ((J & c<60) | c<30).
    """
    n = clean_length(content)
    h = F.instr(_c(content), HEADING_MARK) > 0
    j = (F.instr(_c(content), CHAPTER_CHARS[0]) > 0) & (F.instr(_c(content), CHAPTER_CHARS[1]) > 0)
    if rule == "logic":
        return (n < 30) & h
    if rule == "v2":
        return (n < 40) & h & (j | (n < 20))
    if rule == "briefing":
        return (n < 40) & h & (j | (n < 15))
    if rule == "briefing_v2":
        return h & ((j & (n < 60)) | (n < 30))
    raise ValueError(f"unknown header rule {rule!r}; expected one of {HEADER_RULES}")


def keep_content(content, rule: str = "briefing_v2") -> Column:
    return ~header_only(content, rule)


def reject_reasons(content, category, priority_col, rule: str = "briefing_v2") -> Column:
    """Array of reasons a row is rejected (empty array = kept)."""
    summary_miss = (F.instr(_c(category), "요약") > 0) & (_c(priority_col) > 0)
    return F.array_compact(F.array(
        F.when(is_toc(content), F.lit(REASON_TOC)),
        F.when(header_only(content, rule), F.lit(REASON_HEADER)),
        F.when(summary_miss, F.lit(REASON_SUMMARY))))


def any_tag(tags, selected: Sequence[str]) -> Column:
    """Any selected tag present; an empty selection keeps every row and a
    NULL tag list counts as empty."""
    if not selected:
        return F.lit(True)
    wanted = F.array(*[F.lit(s) for s in selected])
    return F.arrays_overlap(F.coalesce(_c(tags), F.array().cast("array<string>")), wanted)


def not_blank(col) -> Column:
    """Drop '' and NULL."""
    return _c(col).isNotNull() & (_c(col) != "")


def fallback_match(df: DataFrame, col: str, value: str) -> DataFrame:
    """Rows equal to ``value``; if there are none, rows containing it.

    The best tier is a scalar subquery (one small aggregate job), not a
    window over the whole table.
    """
    tier = F.when(F.col(col) == value, F.lit(0)).when(F.instr(F.col(col), value) > 0, F.lit(1))
    tiered = df.withColumn("tier", tier).filter(F.col("tier").isNotNull())
    best = tiered.agg(F.min("tier")).scalar()
    return tiered.filter(F.col("tier") == best)
