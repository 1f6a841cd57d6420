import datetime as dt

from pyspark.sql import functions as F

from almanac.functions import cells, dates, numbers, text
from almanac.operators.tags import categorize, extract_tags, tag_pattern


def one(spark, col, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_py_strip_unicode(spark):
    assert one(spark, text.py_strip("s"), "\u3000 a b\t\x1c\n") == "a b"
    assert one(spark, text.py_strip("s"), "   ") == ""


def test_clean_markdown(spark):
    src = "# Title [link](http://x) **bold** | a-b `c` > q\n\nend"
    assert one(spark, text.clean_markdown("s"), src) == "Title bold a b c q end"


def test_clean_markdown_link_eats_header(spark):
    # The lazy link pattern starts at the first "[" of the line.
    assert one(spark, text.clean_markdown("s"), "# [2024-01-01~2024-01-07] see [a](b)") == ""


def test_embed_text_whole_and_cut_by_characters(spark):
    df = spark.createDataFrame([("# 제목", "가" * 600)], "h string, b string")
    whole = df.select(text.embed_text("h", "b").alias("r")).first()["r"]
    assert whole == "제목. " + "가" * 600
    cut = df.select(text.embed_text("h", "b", max_chars=512).alias("r")).first()["r"]
    assert len(cut) == 512 and cut.startswith("제목. 가")


def test_tag_search_range(spark):
    df = spark.createDataFrame([("# h", "x" * 1500)], "h string, b string")
    assert len(df.select(text.tag_search_range("h", "b")).first()[0]) == 1504
    assert len(df.select(text.tag_search_range("h", "b", body_chars=1000)).first()[0]) == 1004


def test_bracket_text_edges(spark):
    assert one(spark, text.bracket_text("s"), "# [2024-01-01~2024-01-07] t") == "2024-01-01~2024-01-07"
    assert one(spark, text.bracket_text("s"), "no bracket") == ""
    assert one(spark, text.bracket_text("s"), None) is None


def test_after_last(spark):
    assert one(spark, text.after_last("s"), "# [a] 제목 ") == "제목"
    assert one(spark, text.after_last("s"), "plain") == "plain"


def test_number_goldens(spark):
    cases = {"-5": 5.0, "-3.5": -3.5, "10~15": 12.5, "1,234.5": 117.75, "(평년 2.0)": None,
             "5.0 (평년 2.0)": 5.0, "-2~3": 2.5}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["m"] for r in df.select("s", numbers.number_mean("s").alias("m")).collect()}
    assert got == cases


def test_number_signed_mode(spark):
    assert one(spark, numbers.number_mean("s", mode="signed"), "-5") == -5.0


def test_move_to_year_feb29(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 29),), (dt.date(2024, 3, 1),)], "d date")
    got = [r[0] for r in df.select(dates.move_to_year("d", F.lit(2025))).collect()]
    assert got == [None, dt.date(2025, 3, 1)]


def test_cells(spark):
    assert one(spark, cells.cells_nonempty("s"), "| a |  | b |") == ["a", "b"]
    assert one(spark, cells.cells_kept("s"), "| a ||| b ... |  |   ") == ["a", "b"]
    assert one(spark, cells.cells_kept("s"), "|  | x | |") == ["", "x"]
    assert one(spark, cells.cells_kept("s"), "| ··· |") == []
    assert one(spark, cells.has_alnum("s"), "| --- |") is False
    assert one(spark, cells.has_alnum("s"), "| 가 |") is True


def test_tag_golden(spark):
    tags = ["배", "무", "소", "배추", "감자"]
    assert one(spark, extract_tags("s", tags), "배추 배는 소 참무 감자") == ["감자", "배", "배추", "소"]


def test_tag_one_char_particle_rules(spark):
    # T2: "밀도" reads as 밀 + particle 도; a two-syllable particle is a miss.
    assert one(spark, extract_tags("s", ["밀"]), "밀도 조절") == ["밀"]
    assert one(spark, extract_tags("s", ["밀"]), "밀에서 자란") == []


def test_tag_pattern_quotes():
    pat, groups = tag_pattern(["A.I", "x"])
    assert "A\\.I" in pat and groups == 2


def test_categorize_order_and_toc(spark):
    cmap = {"first": ["감자"], "second": ["감"]}
    assert one(spark, categorize("s", cmap), "감 자 재배") == "first"
    assert one(spark, categorize("s", cmap), "단감") == "second"
    assert one(spark, categorize("s", cmap), "목 차") == "SKIP"
    assert one(spark, categorize("s", cmap, skip_toc=False), "없음") == "기타"


def test_session_keeps_what_others_set(spark, monkeypatch):
    from almanac import session
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        assert session.build_session("local[2]") is not None
        assert spark.conf.get("spark.sql.shuffle.partitions") == "2000"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert session.is_local("local") and session.is_local("local[*]")
    assert not session.is_local("local-cluster[2,1,1024]") and not session.is_local(None)


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    import pytest
    from almanac import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, key, default=None):
            return default

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = Context()
    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_texts_without_a_tag_are_not_matched(spark):
    """The regex runs only where a tag stands; null texts stay null, and before many first letters a range is asked."""
    pat, _ = tag_pattern(["벼", "콩", "AI", "-x"])
    assert pat.startswith("(?=[\\-A벼-콩])")
    df = spark.createDataFrame([(0, None), (1, "plain prose " * 20), (2, "벼는 AI -x"), (3, "벼랑")], "i int, t string")
    out = df.select("i", extract_tags("t", ["벼", "콩", "AI", "-x"]).alias("tags"))
    assert {r["i"]: r["tags"] for r in out.collect()} == {0: None, 1: [], 2: ["-x", "AI", "벼"], 3: []}
    assert "contains" in out._jdf.queryExecution().optimizedPlan().toString().lower()
