"""Property tests: render -> parse round trips."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from almanac.operators import tables as tb

values = st.floats(min_value=-500, max_value=500, allow_nan=False).map(lambda x: round(x, 2))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.integers(1, 28), values, st.integers(0, 99)), min_size=1, max_size=8))
def test_weather_table_round_trip(spark, rows):
    lines = ["자료", "| 날짜 | 기온 | 습도 |", "|---|---|---|"]
    lines += [f"| 1월 {d}일 | {v:.2f} (평년 1) | {h} |" for d, v, h in rows]
    df = spark.createDataFrame([(1, "\n".join(lines))], "id long, t string")
    got = tb.weather_table(df, "id", "t", number_mode="signed").orderBy("row_no", "col_no").collect()
    expect = []
    for i, (_, v, h) in enumerate(rows, start=1):
        expect += [(i, 1, "기온", round(v, 2)), (i, 2, "습도", float(h))]
    assert [(r["row_no"], r["col_no"], r["header"], round(r["value"], 2)) for r in got] == expect
    assert all(r["row_valid"] for r in got)
