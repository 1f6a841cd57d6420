""""What was reported at this time of year": nearest week per year, class-wise
pick, and the summary priority rules (R1-R3, R5, R6, W2-W4, A9, A10).

Scale notes. Nothing here windows over a whole year of raw rows. The
briefing reads its source once: the per-class pick uses ``row_number() <= k``
over (year, week, class), which Spark plans as a partial WindowGroupLimit
before the shuffle, so a week holding a third of all rows still ships at most
k rows per class and map task; the week ranking then sees at most a handful
of rows per week. ``nearest_weeks`` alone reduces to one row per (year, week)
with a map-side-combined aggregate and picks with ``min_by``.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.computed import with_computed
from ..functions.dates import day_distance, move_to_year, parse_ymd
from ..functions.text import bracket_text, part

# Class words of titles and categories, and result labels.
SUMMARY_WORDS = ["요약", "요 약"]
WEATHER_WORDS = ["기상"]
WEATHER_CATEGORY_WORDS = ["기상", "농업"]
SUMMARY_CATEGORY_WORD = "요약"
BAND_STRONG, BAND_RELATED, BAND_REFERENCE = "강력 추천", "관련 있음", "참고용"

CLASS_SUMMARY, CLASS_WEATHER, CLASS_OTHER = 0, 1, 2


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _any_contains(col, words) -> Column:
    cond = None
    for w in words:
        c = F.instr(_c(col), w) > 0
        cond = c if cond is None else (cond | c)
    return cond


def title_class(title) -> Column:
    """0 summary, 1 weather, 2 other (by words in the title)."""
    return (F.when(_any_contains(title, SUMMARY_WORDS), F.lit(CLASS_SUMMARY))
            .when(_any_contains(title, WEATHER_WORDS), F.lit(CLASS_WEATHER))
            .otherwise(F.lit(CLASS_OTHER)))


def season_distance(week_range, target: _dt.date, wrap: bool = False) -> Column:
    """Days between ``target`` and the week's start moved into the
    target's year; NULL when the start does not parse or the move fails.
    No wrap-around by default (2 Jan vs 29 Dec = 361, as in the rule)."""
    start = parse_ymd(part(week_range, "~", 1))
    moved = move_to_year(start, F.lit(target.year))
    d = day_distance(F.lit(target).cast("date"), moved)
    if wrap:
        d = F.least(d, F.lit(365) - d)
    return d


def nearest_weeks(rows: DataFrame, target: _dt.date, year_col: str = "year",
                  week_col: str = "w_range") -> DataFrame:
    """Per year, the week whose start is closest to ``target``.

    Ties go to the smaller week string; a year whose weeks all fail to parse
    keeps its smallest week (the rule's "first group" fallback).
    Output: one row per year -> (year, best_week, best_diff).
    """
    weeks = rows.select(year_col, week_col).distinct()
    scored = weeks.withColumn("_d", season_distance(week_col, target))
    key = F.struct(F.coalesce(F.col("_d"), F.lit(1 << 30)).alias("d"),
                   F.col(week_col).alias("w"))
    return (scored.groupBy(year_col)
            .agg(F.min_by(F.col(week_col), key).alias("best_week"),
                 F.min_by(F.col("_d"), key).alias("best_diff")))


def nearest_weeks_by_day(targets: DataFrame, rows: DataFrame, day_col: str = "day", year_col: str = "year",
                         week_col: str = "w_range", wrap: bool = False) -> DataFrame:
    """W2 / A10 / R6 for a table of target days: ``nearest_weeks`` of every day, as columns (year, best_week,
    best_diff) beside those of ``targets``, one row per target and year.

    The distance depends on the day of the year and on whether the target's year is a leap year, so
    every year of ``rows`` gets a calendar of at most 366 + 365 days with the nearest week of each: the week
    that starts last before a day or first after it (with ``wrap`` also the year's first and last). Targets
    meet the calendars by an equi-join, however many they are. A null target day has no row; columns
    ``year``, ``best_week`` and ``best_diff`` of the targets are replaced.
    """
    weeks = rows.select(F.col(year_col).alias("year"), F.col(week_col).alias("week")).distinct()
    start = parse_ymd(part("week", "~", 1))
    kinds = F.array(*[F.struct(F.lit(leap).alias("leap"), F.dayofyear(move_to_year(start, F.lit(year))).alias("doy"))
                      for leap, year in ((True, 2024), (False, 2023))])
    starts = (weeks.select("year", "week", F.explode(kinds).alias("k")).groupBy("year", "k.leap", "k.doy")
              .agg(F.min(F.struct("week"))["week"].alias("week")))
    ends = starts.groupBy("year", "leap").agg(
        F.min(F.when(F.col("doy").isNull(), F.struct("week"))).alias("unmoved"),
        F.min(F.when(F.col("doy").isNotNull(), F.struct("doy", "week"))).alias("first"),
        F.max(F.when(F.col("doy").isNotNull(), F.struct("doy", "week"))).alias("last"))
    days = ends.withColumn("doy", F.explode(F.sequence(F.lit(1), F.when(F.col("leap"), 366).otherwise(365))))
    here = starts.where("doy IS NOT NULL").select(
        F.col("year").alias("of_year"), F.col("leap").alias("of_leap"), F.col("doy").alias("of_doy"), F.struct("doy", "week").alias("here"))
    days = days.join(here, F.col("year").eqNullSafe(F.col("of_year")) & (F.col("leap") == F.col("of_leap"))
                     & (F.col("doy") == F.col("of_doy")), "left")
    order = Window.partitionBy("year", "leap").orderBy("doy")
    before = F.last("here", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("here", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    found = days.withColumns({"before": before, "after": after})

    def scored(week: str) -> Column:
        d = F.abs(F.col("doy") - F.col(f"{week}.doy"))
        d = F.least(d, F.lit(365) - d) if wrap else d
        return F.when(F.col(week).isNotNull(), F.struct(d.alias("d"), F.col(f"{week}.week").alias("week")))
    # Without a week that can be moved all candidates are null, and the smallest week string stays.
    best = F.array_min(F.array(*[scored(w) for w in (["before", "after", "first", "last"] if wrap else ["before", "after"])]))
    calendar = found.withColumn("best", best).select(
        F.col("leap").alias("__leap"), F.col("doy").alias("__doy"), "year",
        F.coalesce("best.week", "unmoved.week").alias("best_week"), F.col("best.d").alias("best_diff"))
    kept = targets.drop("year", "best_week", "best_diff")
    day = F.col(day_col).cast("date")
    leap = F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31))) == 366
    return (kept.withColumns({"__leap": leap, "__doy": F.dayofyear(day)}).join(calendar, ["__leap", "__doy"])
            .drop("__leap", "__doy"))


def briefing(bulletins: DataFrame, target: _dt.date, month: int | None = None,
             week_range: str | None = None, crops: Sequence[str] = (),
             years: Sequence[int] | None = None, per_year: int = 4,
             tags_col: str = "tags") -> DataFrame:
    """The dashboard briefing as one lazy plan.

    Mode A (``week_range`` given): rows whose title contains the week text.
    Mode B (``month`` given): rows of that month whose content is not a table
    of contents. Then the crop filter (any-of; empty means all), the known
    years, the nearest week per year, and per year the first summary, the
    first weather item and the other items, at most ``per_year`` in total.

    Output columns: year, rank, id, title, w_range, item_class, tags.
    """
    df = bulletins
    if week_range is not None:
        df = df.filter(F.instr(F.col("title"), week_range) > 0)            # P3
    if month is not None:
        df = df.filter((F.col("month") == month)                           # P2
                       & ~(F.instr(F.col("content_md"), "목 차") > 0))      # P4
    if crops:                                                              # P8
        wanted = F.array(*[F.lit(c) for c in crops])
        df = df.filter(F.arrays_overlap(
            F.coalesce(F.col(tags_col), F.array().cast("array<string>")), wanted))
    if years is not None:                                                  # P13
        df = df.filter(F.col("year").isin(list(years)))
    df = (df.withColumn("w_range", bracket_text("title"))                   # F8
          .filter(F.col("w_range").isNotNull() & (F.col("w_range") != "")))  # P14

    # Single scan of the source. First cut every (year, week, class) group to
    # the rows it can contribute (1 summary, 1 weather, per_year others) with
    # a partial WindowGroupLimit before the shuffle; only then rank the weeks
    # of a year, over at most 2 + per_year rows per week.
    df = df.select("id", "year", "title", "w_range", F.col(tags_col).alias("tags"))
    df = df.withColumn("item_class", title_class("title"))
    in_class = Window.partitionBy("year", "w_range", "item_class").orderBy("id")
    cand = (df.withColumn("_rn", F.row_number().over(in_class))
            .filter((F.col("_rn") <= per_year)
                    & ((F.col("item_class") == CLASS_OTHER) | (F.col("_rn") == 1))))
    dist = F.coalesce(season_distance("w_range", target), F.lit(1 << 30))
    by_week = Window.partitionBy("year").orderBy(dist, "w_range")
    cand = (cand.withColumn("_wk", F.dense_rank().over(by_week))
            .filter(F.col("_wk") == 1))
    by_year = Window.partitionBy("year").orderBy("item_class", "_rn")
    return (cand.withColumn("rank", F.row_number().over(by_year))
            .filter(F.col("rank") <= per_year)
            .select("year", "rank", "id", "title", "w_range", "item_class", "tags"))


# --- R1-R3: priority of a row for a given day ------------------------------------

def _summary_dates(id_col):
    pieces = F.split(_c(id_col), "_", -1)
    ok = F.size(pieces) == 2
    start = parse_ymd(F.try_element_at(pieces, F.lit(1)))
    end = parse_ymd(F.try_element_at(pieces, F.lit(2)))
    return ok, start, end


def priority(id_col, year_col, category_col, today: _dt.date,
             near_days: int | None = None, parsed_dates=None) -> Column:
    """R1 (``near_days=None``) / R2 (``near_days=7``): summary rows whose week
    contains today's month/day in the row's year rank 0 (R2: also within
    ``near_days`` of either end); other summaries 1 (R2: 100, including
    malformed ids); weather/agriculture 2; everything else 99."""
    cat = _c(category_col)
    ok, start, end = (_summary_dates(id_col) if parsed_dates is None
                      else tuple(F.col(c) for c in parsed_dates))
    year = _c(year_col).cast("string")
    check = F.try_to_date(F.format_string("%s-%s", year.try_cast("int").cast("string"),
                                          F.lit(today.strftime("%m-%d"))),
                          "yyyy-MM-dd")
    valid = ok & start.isNotNull() & end.isNotNull() & check.isNotNull()
    inside = valid & (start <= check) & (check <= end)
    miss = F.lit(1) if near_days is None else F.lit(100)
    summary = F.when(inside, F.lit(0))
    if near_days is not None:
        near = valid & ((day_distance(check, start) <= near_days)
                        | (day_distance(check, end) <= near_days))
        summary = summary.when(near, F.lit(0))
    summary = summary.otherwise(miss)
    return (F.when(F.instr(cat, SUMMARY_CATEGORY_WORD) > 0, summary)
            .when(_any_contains(cat, WEATHER_CATEGORY_WORDS), F.lit(2))
            .otherwise(F.lit(99)))


def priority_reason(id_col, year_col, category_col, today: _dt.date,
                    near_days: int | None = None, parsed_dates=None) -> Column:
    """The label that goes with :func:`priority`."""
    cat = _c(category_col)
    ok, start, end = (_summary_dates(id_col) if parsed_dates is None
                      else tuple(F.col(c) for c in parsed_dates))
    year = _c(year_col).cast("string")
    check = F.try_to_date(F.format_string("%s-%s", year.try_cast("int").cast("string"),
                                          F.lit(today.strftime("%m-%d"))),
                          "yyyy-MM-dd")
    valid = ok & start.isNotNull() & end.isNotNull() & check.isNotNull()
    inside = valid & (start <= check) & (check <= end)
    # The later rule version reports a malformed id as a plain miss.
    malformed = "Format Err" if near_days is None else "NO MATCH"
    summary = F.when(~ok, F.lit(malformed)).when(~valid, F.lit("ERR")) \
        .when(inside, F.lit("MATCH"))
    if near_days is not None:
        near = ((day_distance(check, start) <= near_days)
                | (day_distance(check, end) <= near_days))
        summary = summary.when(near, F.lit("NEAR MATCH"))
    summary = summary.otherwise(F.lit("NO MATCH"))
    return (F.when(F.instr(cat, SUMMARY_CATEGORY_WORD) > 0, summary)
            .when(_any_contains(cat, WEATHER_CATEGORY_WORDS), F.lit("Weather"))
            .otherwise(F.lit("Other")))


def with_priority(df: DataFrame, id_col: str, year_col: str, category_col: str,
                  today: _dt.date, near_days: int | None = None, name: str = "priority",
                  reason: str | None = "reason") -> DataFrame:
    """R1-R3 as columns, with the id's dates parsed once per row."""
    ok, start, end = _summary_dates(id_col)
    parsed = with_computed(df, _pid_ok=ok, _pid_start=start, _pid_end=end)
    pieces = ("_pid_ok", "_pid_start", "_pid_end")
    out = parsed.withColumn(name, priority(id_col, year_col, category_col, today, near_days,
                                           parsed_dates=pieces))
    if reason:
        out = out.withColumn(reason, priority_reason(id_col, year_col, category_col, today,
                                                     near_days, parsed_dates=pieces))
    return out.drop(*pieces)


def relevance_band(score, strong: float = 0.65, related: float = 0.50) -> Column:
    """Strong / related / reference band of a similarity score."""
    s = _c(score)
    return (F.when(s >= strong, F.lit(BAND_STRONG))
            .when(s >= related, F.lit(BAND_RELATED))
            .otherwise(F.lit(BAND_REFERENCE)))
