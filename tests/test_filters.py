from pyspark.sql import functions as F

from almanac.operators import filters


def test_header_only_v2_goldens(spark):
    # Expected values follow the rule (the first printed expectation contradicts it).
    cases = [("### 요약\n내용이 충분히 김...", 18, False), ("### 제1장 벼", 9, False),
             ("### 제 7장 축산", 11, False), ("기상 정보입니다.", 9, True),
             ("### 짧은 요약", 9, False), ("### 비교적 긴 요약이지만 40자는 안되는 경우", 27, True)]
    df = spark.createDataFrame([(c,) for c, _, _ in cases], "c string")
    got = df.select(filters.clean_length("c").alias("n"),
                    filters.keep_content("c", "v2").alias("k")).collect()
    assert [(r["n"], r["k"]) for r in got] == [(n, k) for _, n, k in cases]


def test_header_only_variants(spark):
    # cleaned lengths 26, 48, 28, 16; J = has 제 and 장
    cases = [("### " + "가" * 22, [True, False, False, True]),
             ("### 제3장 " + "가" * 40, [False, False, False, True]),
             ("### 제3장 " + "가" * 20, [True, True, True, True]),
             ("### " + "가" * 12, [True, True, False, True])]
    df = spark.createDataFrame([(c,) for c, _ in cases], "c string")
    rows = df.select(*[filters.header_only("c", r).alias(r) for r in filters.HEADER_RULES]).collect()
    assert [[row[r] for r in filters.HEADER_RULES] for row in rows] == [e for _, e in cases]


def test_any_tag_empty_selection_and_null(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, None)], "id int, t array<string>")
    assert df.filter(filters.any_tag("t", [])).count() == 2
    assert [r[0] for r in df.filter(filters.any_tag("t", ["a", "z"])).select("id").collect()] == [1]


def test_fallback_match_uses_like_when_no_exact(spark):
    df = spark.createDataFrame([(1, "주간요약"), (2, "기상")], "id int, category string")
    out = filters.fallback_match(df, "category", "요약").collect()
    assert [(r["id"], r["tier"]) for r in out] == [(1, 1)]
    df2 = df.union(spark.createDataFrame([(3, "요약")], "id int, category string"))
    assert [r["id"] for r in filters.fallback_match(df2, "category", "요약").collect()] == [3]


def test_reject_reasons(spark):
    df = spark.createDataFrame([("목 차", "요약", 100), ("본문 " * 20, "벼", 99)],
                               "c string, cat string, p int")
    got = [r[0] for r in df.select(filters.reject_reasons("c", "cat", "p")).collect()]
    assert got == [["MOKCHA FILTER", "NON-MATCH SUMMARY"], []]
