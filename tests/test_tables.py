from almanac.operators import tables as tb

BROKEN = "\n".join(["요약 정보입니다.", "| 제1장 | 농 | |", "| 업 | 1 | |", "| 제2장 | 재 | |",
                    "| 배 | 5 | |", "일반 텍스트입니다."])


def repaired(spark, fn, text):
    df = spark.createDataFrame([(1, text)], "id long, t string")
    return fn(df, "id", "t").first()["repaired"]


def test_light_repair_golden(spark):
    assert repaired(spark, tb.repair_tables_light, BROKEN) == "\n".join([
        "요약 정보입니다.", "| 제1장 | 농 |  |", "|---|---|---|", "| 업 | 1 |  |",
        "| 제2장 | 재 |  |", "| 배 | 5 |  |", "일반 텍스트입니다."])


def test_light_repair_hyphen_row_suppresses_separator(spark):
    assert repaired(spark, tb.repair_tables_light, "| a | b |\n| -5 | 3 |") == "| a | b |\n| -5 | 3 |"


def test_light_repair_without_pipes_is_identity(spark):
    assert repaired(spark, tb.repair_tables_light, "a\n\nb\n") == "a\n\nb\n"


def test_strong_repair_golden(spark):
    assert repaired(spark, tb.repair_tables, BROKEN) == "\n".join([
        "요약 정보입니다.", "| 제1장 | 농 |", "| --- | --- |", "| 업 | 1 |", "| 제2장 | 재 |",
        "| 배 | 5 |", "일반 텍스트입니다."])


def test_strong_repair_wide_ragged_dots_and_rule_row(spark):
    text = "\n".join(["intro", "|---|", "| a | b | c | d | e | f | g |", "| x ||| y ... |",
                      "|---|---|", "| 1 |", "end"])
    assert repaired(spark, tb.repair_tables, text) == "\n".join([
        "intro", "|---|", "| a | b | c | d | e f g |", "| --- | --- | --- | --- | --- |",
        "| x | y |  |  |  |", "| --- | --- |  |  |  |", "| 1 |  |  |  |  |", "end"])


def test_strong_repair_one_column_and_splitlines(spark):
    assert repaired(spark, tb.repair_tables, "a |\nb |") == "a\nb"
    assert repaired(spark, tb.repair_tables, "x\r\ny\n") == "x\ny"
    assert repaired(spark, tb.repair_tables, "x\u2028y z\x0cw") == "x\ny z\nw"


def test_weather_table(spark):
    text = "\n".join(["캡션", "| 날짜 | 기온 | 습도 | 비고 |", "|---|---|---|---|",
                      "| 1일 | -5 (평년 2) | 60 | a |", "| 2일 | 3.5 | - | b |", "| 3 |"])
    df = spark.createDataFrame([(7, text)], "id long, t string")
    rows = tb.weather_table(df, "id", "t").orderBy("row_no", "col_no").collect()
    got = [(r["row_no"], r["col_no"], r["header"], r["value"], r["row_valid"]) for r in rows]
    assert got == [(1, 1, "기온", 5.0, True), (1, 2, "습도", 60.0, True),
                   (2, 1, "기온", 3.5, False), (2, 2, "습도", None, False)]


def test_weather_table_rejections(spark):
    texts = ["| a | 기온 |\n| 1 | 2 |",                      # fewer than 3 pipe lines
             "|---|---|\n| 날짜 | 기온 |\n| 1 | 2 |",        # separator first
             "| 날짜 | 풍속 |\n|---|---|\n| 1 | 2 |"]          # no measure word
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    assert tb.weather_table(df, "id", "t").count() == 0
