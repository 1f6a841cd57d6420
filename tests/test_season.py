import datetime as dt

import pytest
from pyspark.sql import functions as F

from almanac.operators import season

TODAY = dt.date(2025, 1, 7)


def test_priority_goldens(spark):
    items = [("2025-01-06_2025-01-12", "2025", "요약"), ("2025-01-13_2025-01-19", "2025", "요약"),
             ("2025-01-06_2025-01-12", "2025", "기상"), ("2025-01-06_2025-01-12", "2025", "벼"),
             ("bad", "2025", "요약"), ("2025-01-06_2025-01-12", "x", "주간요약")]
    df = spark.createDataFrame(items, "id string, year string, cat string")
    rows = df.select(season.priority("id", "year", "cat", TODAY).alias("s"),
                     season.priority("id", "year", "cat", TODAY, 7).alias("n"),
                     season.priority_reason("id", "year", "cat", TODAY).alias("rs"),
                     season.priority_reason("id", "year", "cat", TODAY, 7).alias("rn")).collect()
    assert [r["s"] for r in rows] == [0, 1, 2, 99, 1, 1]
    assert [r["n"] for r in rows] == [0, 0, 2, 99, 100, 100]
    assert [r["rs"] for r in rows] == ["MATCH", "NO MATCH", "Weather", "Other", "Format Err", "ERR"]
    assert [r["rn"] for r in rows][:2] == ["MATCH", "NEAR MATCH"]


def test_priority_feb29_is_an_error(spark):
    df = spark.createDataFrame([("2025-02-24_2025-03-02", "2025", "요약")], "id string, year string, cat string")
    r = df.select(season.priority("id", "year", "cat", dt.date(2024, 2, 29))).first()[0]
    assert r == 1


def test_season_distance_no_wrap(spark):
    df = spark.createDataFrame([("2023-12-29~2024-01-04",), ("2024-02-29~2024-03-06",)], "w string")
    got = [r[0] for r in df.select(season.season_distance("w", dt.date(2025, 1, 2))).collect()]
    assert got == [361, None]
    got = [r[0] for r in df.select(season.season_distance("w", dt.date(2025, 1, 2), wrap=True)).collect()]
    assert got[0] == 4


def _rows(spark, items):
    return spark.createDataFrame(
        items, "id long, year int, month int, title string, content_md string, tags array<string>")


def test_briefing_pick_and_cap(spark):
    t = lambda w, c: f"# [{w}] {c}"
    near, far = "2024-01-08~2024-01-14", "2024-01-22~2024-01-28"
    items = [
        (1, 2024, 1, t(near, "요약"), "a", ["x"]), (2, 2024, 1, t(near, "요 약"), "b", ["x"]),
        (3, 2024, 1, t(near, "기상"), "c", ["y"]), (4, 2024, 1, t(near, "기상"), "d", None),
        (5, 2024, 1, t(near, "벼"), "e", ["y"]), (6, 2024, 1, t(near, "채소"), "f", ["x"]),
        (7, 2024, 1, t(near, "과수"), "g", ["x"]), (8, 2024, 1, t(far, "요약"), "h", ["x"]),
        (9, 2024, 1, t(near, "벼"), "목 차", ["x"]), (10, 2023, 1, "# no week", "i", ["x"]),
    ]
    out = season.briefing(_rows(spark, items), TODAY, month=1).collect()
    assert [(r["year"], r["rank"], r["id"]) for r in out] == [(2024, 1, 1), (2024, 2, 3),
                                                              (2024, 3, 5), (2024, 4, 6)]
    crop = season.briefing(_rows(spark, items), TODAY, month=1, crops=["y"]).collect()
    assert [r["id"] for r in crop] == [3, 5]


def test_briefing_invariant_under_partitioning(spark):
    t = lambda w, c: f"# [{w}] {c}"
    items = [(i, 2023 + i % 3, 1, t(f"{2023 + i % 3}-01-{2 + 7 * (i % 4):02d}~x", "요약" if i % 5 == 0 else "벼"),
              "z", ["x"]) for i in range(200)]
    df = _rows(spark, items)
    a = season.briefing(df, TODAY, month=1).collect()
    b = season.briefing(df.repartition(7), TODAY, month=1).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_nearest_weeks_fallback(spark):
    df = spark.createDataFrame([(2024, "zz~"), (2024, "aa~")], "year int, w_range string")
    r = season.nearest_weeks(df, TODAY).first()
    assert r["best_week"] == "aa~" and r["best_diff"] is None


def test_relevance_band(spark):
    df = spark.createDataFrame([(0.7,), (0.5,), (0.45,)], "s double")
    assert [r[0] for r in df.select(season.relevance_band("s")).collect()] == ["강력 추천", "관련 있음", "참고용"]


@pytest.mark.parametrize("wrap", [False, True])
def test_nearest_weeks_of_many_days_equal_one_day_at_a_time(spark, wrap):
    """366 days of a leap year and some of others, malformed and missing weeks, 29 February, ties, null days."""
    starts = {2023: ["2023-01-02", "2023-03-01", "2023-03-11", "2023-12-25", "bad"], 2024: ["2024-02-29", "2024-07-01"],
              2020: ["2020-02-29"], 2021: ["x", "w"], 2022: ["2022-06-01", "2021-06-01"]}
    weeks = [(y, f"{s}~end") for y, ws in starts.items() for s in ws] + [(2022, "2022-06-01~end")]
    rows = spark.createDataFrame(weeks, "year int, w_range string")
    days = ([dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(366)]
            + [dt.date(2023, 1, 1), dt.date(2023, 2, 28), dt.date(2023, 3, 6), dt.date(2023, 12, 31), None])
    targets = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "day date, year int")
    found = season.nearest_weeks_by_day(targets, rows, wrap=wrap).collect()
    assert len(found) == (len(days) - 1) * len(starts)

    def distance(week, day):
        try:
            d = abs((day - dt.date.fromisoformat(week[:10]).replace(year=day.year)).days)
        except ValueError:
            return None
        return min(d, 365 - d) if wrap else d
    for r in found:
        scored = [(distance(w, r["day"]), w) for y, w in set(weeks) if y == r["year"]]
        best = min(scored, key=lambda s: (1 << 30 if s[0] is None else s[0], s[1]))
        assert (r["best_diff"], r["best_week"]) == best, r
