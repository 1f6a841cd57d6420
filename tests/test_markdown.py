import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from almanac.operators import weeks as wk
from almanac.sources import markdown as md
from almanac.sources import sinks

FILE_A = ("preamble line\n"
          "# [2024-01-01~2024-01-07] 주간 요약\n  첫 줄  \n\n둘째 줄\n"
          "#   [2024-01-01~2024-01-07] 기상 전망\r\n비 옴\r\n"
          "# [2024-01-08~2024-01-14] 목 차\n1. 어쩌구\n"
          "# [2024-01-08~2024-01-14] 배추 관리\n물 주기\n"
          "# no date here\n떠도는 줄\n"
          "# [2024-01-08~2024-01-14] 사과와 배추\n전정\n")


def write_dir(files):
    d = tempfile.mkdtemp(prefix="almanac-md-")
    for name, body in files.items():
        with open(os.path.join(d, name), "w", encoding="utf-8", newline="") as f:
            f.write(body)
    return d


def test_read_sections(spark):
    d = write_dir({"a.md": FILE_A})
    rows = md.read_sections(spark, d).orderBy("section_no").collect()
    assert [(r["year"], r["month"], r["title"]) for r in rows] == [
        (2024, 1, "# [2024-01-01~2024-01-07] 주간 요약"),
        (2024, 1, "# [2024-01-01~2024-01-07] 기상 전망"),
        (2024, 1, "# [2024-01-08~2024-01-14] 배추 관리"),
        (2024, 1, "# [2024-01-08~2024-01-14] 사과와 배추")]
    assert rows[0]["content_md"] == "  첫 줄  \n\n둘째 줄"
    assert rows[2]["content_md"] == "물 주기\n# no date here\n떠도는 줄"


def test_weeks_per_file_and_map_order(spark):
    d = write_dir({"a.md": FILE_A, "b.md": "# [2024-01-08~2024-01-14] 벼 농사\n논 물대기\n"})
    weeks = (wk.to_weeks(wk.week_sections(md.bulletin_dir_files(spark, d)), per_file=True)
             .withColumn("keys", F.map_keys("content")).collect())
    assert [(w["id"], w["year"], w["month"]) for w in weeks] == [
        ("2024-01-01~2024-01-07", "2024", 1), ("2024-01-08~2024-01-14", "2024", 1),
        ("2024-01-08~2024-01-14", "2024", 1)]
    # Collected maps become dicts through a hash map: check the order on the keys.
    assert weeks[0]["keys"] == ["요약", "기상"]
    assert weeks[0]["content"] == {"요약": "첫 줄\n둘째 줄", "기상": "비 옴"}
    second = [w["content"] for w in weeks[1:]]
    # "사과와 배추" -> 채소 (채소 precedes 과수 in the dictionary), merged with 배추 관리.
    assert {"채소": "물 주기\n# no date here\n떠도는 줄\n전정"} in second
    assert {"벼": "논 물대기"} in second


def test_json_con_preferred(spark):
    d = write_dir({"top.md": "# [2024-02-05~2024-02-11] 벼\n본문\n"})
    os.makedirs(os.path.join(d, "json_con"))
    with open(os.path.join(d, "json_con", "x.md"), "w", encoding="utf-8") as f:
        f.write("# [2024-03-04~2024-03-10] 양봉\n벌통\n")
    ids = [w["id"] for w in wk.to_weeks(wk.week_sections(md.bulletin_dir_files(spark, d))).collect()]
    assert ids == ["2024-03-04~2024-03-10"]


def test_weeks_json_keeps_map_order(spark):
    d = write_dir({"a.md": FILE_A})
    out = wk.weeks_json(wk.to_weeks(wk.week_sections(md.read_files(spark, d)), per_file=False))
    first = json.loads(out.first()["json"])
    assert list(first["content"]) == ["요약", "기상"]


def test_render_and_read_round_trip(spark):
    rows = [(i, f"2024-01-{1 + 7 * (i % 3):02d}", 2024, f"# [w{i % 3}] t{i}", f"body {i}\n# [not a header")
            for i in range(30)]
    df = spark.createDataFrame(rows, "id long, week_start string, year int, title string, content_md string")
    path = tempfile.mkdtemp(prefix="almanac-render-") + "/out"
    md.render_markdown(df, path)
    back = md.read_files(spark, path, glob="*.txt").collect()
    text = "\n".join(r["text"] for r in back)
    assert "\n\\# [not a header" in text and text.count("# [w") == 30


def test_ingest_is_idempotent(spark):
    from almanac.session import scratch_path
    d = write_dir({"a.md": FILE_A})
    rows = sinks.farm_rows(md.read_sections(spark, d))
    table = scratch_path(spark, "ingest-test")
    assert sinks.ingest(spark, rows, table) == 4
    assert sinks.ingest(spark, rows, table) == 0
    stored = spark.read.parquet(table)
    assert stored.count() == 4
    assert stored.filter(F.size("tags_crop") > 0).count() >= 1


@pytest.mark.parametrize("split", [False, True])
def test_ingest_new_corrected_and_moved_sections(spark, split):
    from almanac.session import scratch_path
    week = "# [2024-01-0{0}~2024-01-0{0}] 벼\n본문 {0}\n"
    old = week.format(1) + week.format(2) + "# [2024-01-02~2024-01-02] 벼\n둘째\n"
    table = scratch_path(spark, "ingest-change")

    def ingest(files):
        return sinks.ingest(spark, sinks.farm_rows(md.read_sections(spark, write_dir(files), split_on_read=split)), table)

    def stored():
        return sorted((r["title"], r["occurrence"], r["content_md"], r["revision"]) for r in sinks.current(spark, table).collect())
    assert ingest({"w.md": old}) == 3 and ingest({"w.md": old}) == 0      # the second is in another folder
    assert ingest({"w.md": week.format(5) + old}) == 1                    # a new bulletin on top
    assert ingest({"w.md": week.format(5) + old.replace("둘째", "고침")}) == 1
    assert ingest({"w.md": week.format(5) + old.replace("둘째", "고침")}) == 0
    title = "# [2024-01-0{0}~2024-01-0{0}] 벼"
    assert stored() == [(title.format(1), 0, "본문 1", 0), (title.format(2), 0, "본문 2", 0),
                        (title.format(2), 1, "고침", 1), (title.format(5), 0, "본문 5", 0)]
    assert ingest({"other.md": week.format(1)}) == 1                      # another file, another section


def test_both_read_modes_give_the_same_sections_and_ids(spark):
    files = {"a.md": "#[2024-01-01~2024-01-07] 벼\n하나\n# [2024-01-08~2024-01-14] 콩\n둘\n#  [2024-01-15~2024-01-21] 무\n셋\n",
             "b.md": "머리말\n\n# [2024-02-01~2024-02-07] 벼\r\n넷\r\n# [2024-02-01~2024-02-07] 벼\r\n다섯\r\n",
             "c.md": "# [2024-03-01~2024-03-07] 벼\n여섯"}
    d = write_dir(files)
    got = [sorted((r["id"], r["title"], r["content_md"]) for r in sinks.farm_rows(
        md.read_sections(spark, d, split_on_read=split)).collect()) for split in (False, True)]
    assert got[0] == got[1] and len(got[0]) == 6


def test_a_large_file_is_read_by_several_tasks_in_order(spark):
    body = "".join(f"# [2024-01-01~2024-01-07] 벼\n줄 {i} {'x' * 200}\n" for i in range(4000))
    d = write_dir({"big.md": body})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        sections = md.read_sections(spark, d, split_on_read=True)
        assert sections.rdd.getNumPartitions() > 4
        rows = sinks.farm_rows(sections).select("occurrence", "content_md").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(r["content_md"].startswith(f"줄 {r['occurrence']} ") for r in rows) and len(rows) == 4000


def test_split_on_read_matches_wholetext(spark):
    body = "".join(f"# [2024-01-{d:02d}~2024-01-{d + 6:02d}] 벼\n줄 {d}\n" for d in range(1, 20))
    d = write_dir({"big.md": body})
    a = sorted((r["title"], r["content_md"]) for r in md.read_sections(spark, d).collect())
    split = md.read_sections(spark, d, split_on_read=True)
    b = sorted((r["title"], r["content_md"]) for r in split.collect())
    assert a == b and len(a) == 19
    assert sinks.farm_rows(split).select("id").distinct().count() == 19


def test_flat_rows_equal_flattened_map(spark):
    d = write_dir({"a.md": FILE_A, "b.md": "# [2024-01-08~2024-01-14] 벼 농사\n논 물대기\n"})
    secs = wk.week_sections(md.bulletin_dir_files(spark, d))
    a = sorted(map(tuple, wk.flatten_weeks(wk.to_weeks(secs)).collect()))
    b = sorted(map(tuple, wk.flat_week_rows(secs).collect()))
    assert a == b and len(a) == 4


def test_files_of_one_name_in_two_folders_are_two(spark):
    """Identity is the path below the root: ingested one after the other, neither replaces the other; a moved root is the same."""
    import shutil

    from almanac.api import Archive
    from almanac.session import scratch_path
    root = tempfile.mkdtemp(prefix="almanac roots+")
    for name, text in (("a", "첫째"), ("b", "둘째")):
        os.makedirs(f"{root}/{name}")
        with open(f"{root}/{name}/weekly.md", "w", encoding="utf-8") as f:
            f.write(f"# [2024-01-01~2024-01-07] 벼\n{text}\n")
    table = scratch_path(spark, "two-folders")

    def ingest(folder, root):
        sections = md.read_sections(spark, folder)
        return sinks.ingest(spark, sinks.farm_rows(sections, file_name=sinks.below(root)), table)
    assert [ingest(f"{root}/a", root), ingest(f"{root}/b", root), ingest(f"{root}/a", root)] == [1, 1, 0]
    assert {r.content_md.strip() for r in sinks.current(spark, table).collect()} == {"첫째", "둘째"}
    moved = tempfile.mkdtemp(prefix="almanac-moved-") + "/deep/er"
    shutil.copytree(root, moved)
    assert ingest(moved, f"file://{moved}/") == 0
    assert Archive.from_markdown(spark, moved).df.select("file_name").distinct().count() == 2


def test_first_ingest_that_died_is_done_again(spark):
    """A folder with Spark's _temporary in it, or one without any file, is an empty table."""
    from almanac.session import scratch_path
    d = write_dir({"a.md": FILE_A})
    rows = sinks.farm_rows(md.read_sections(spark, d))
    table = scratch_path(spark, "died")
    spark.range(2).write.parquet(f"{table}/_temporary/0/x")
    assert sinks.ingest(spark, rows, table) == 4 and sinks.ingest(spark, rows, table) == 0
    assert sinks.current(spark, table).count() == 4


def test_damaged_files_fail_or_are_listed(spark):
    import gzip

    d = write_dir({"a.md": FILE_A})
    whole = gzip.compress(("# [2024-05-01~2024-05-07] 벼\n" + "가나다라 " * 5000).encode())
    for name, data in (("good.md.gz", whole), ("cut.md.gz", whole[:len(whole) // 2])):
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    with pytest.raises(Exception, match="cut.md.gz|EOF|Unexpected end"):
        md.read_sections(spark, d, glob="*.md*").count()
    kept = {os.path.basename(r.file) for r in md.bulletin_dir_files(spark, d, "*.md*").select("file").collect()}
    lost = {os.path.basename(r.file) for r in md.damaged_files(spark, d, "*.md*").collect()}
    assert kept == {"a.md", "good.md.gz"} and lost == {"cut.md.gz"}


def test_a_bulletin_folder_is_read_in_pieces(spark):
    """Large files come in several rows, and sections equal those of whole files: other blanks in headers,
    preambles that look like a section's rest, line ends, empty and compressed files."""
    import gzip

    body = "".join(f"# [2024-01-01~2024-01-07] 벼\n줄 {i} {'x' * 200}\n#\t[2024-02-01~2024-02-07] 콩\r\n# 소 {i}\n" for i in range(900))
    files = {"big.md": body, "pre.md": "2024-03-04~2024-03-10] 머리말\n# [2024-04-01~2024-04-07] 벼\n글",
             "named.md": "주간 [2024-05-06~2024-05-12]\n글\r\n# [2024-05-13~2024-05-19] 콩\r글", "empty.md": "", "blank.md": "\n# [2024-06-03~2024-06-09] 벼\n",
             "x.txt": "# [2024-07-01~2024-07-07] 벼\n"}
    d = write_dir(files)
    whole = gzip.compress(("# [2024-05-01~2024-05-07] 벼\n" + "가나다라 " * 5000).encode())
    for name, data in (("good.md.gz", whole), ("cut.md.gz", whole[:len(whole) // 2])):
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        pieces = md.bulletin_dir_files(spark, d, "*.md*", split_on_read=True)
        assert pieces.where(F.col("file").contains("big.md")).count() == 900
        assert pieces.where(F.col("file").contains("big.md")).select(F.spark_partition_id()).distinct().count() > 1
        got, want = [sorted((r["file"], r["title"], r["content_md"]) for r in md.split_sections(f).collect())
                     for f in (pieces, md.bulletin_dir_files(spark, d, "*.md*"))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want and len(got) == 1800 + 1 + 2 + 1 + 1


def test_ingest_deals_the_texts_once(spark):
    """The look at the stored keys shuffles them, not the texts again; equal headers and corrections count as before."""
    d = write_dir({"a.md": "".join(f"# [2024-0{1 + i % 3}-01~2024-0{1 + i % 3}-07] 벼\n줄 {i}\n" for i in range(30))})
    table, seen = tempfile.mkdtemp(prefix="almanac-once-") + "/t", []

    def spy(rows):
        seen.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows
    assert sinks.ingest(spark, sinks.section_rows(md.read_sections(spark, d)), table, enrich=spy) == 30
    with open(os.path.join(d, "a.md"), "a", encoding="utf-8") as f:
        f.write("# [2024-01-01~2024-01-07] 벼\n새 줄\n")
    for want in (1, 0):
        assert sinks.ingest(spark, sinks.section_rows(md.read_sections(spark, d)), table, enrich=spy) == want
    # A shuffle of the texts, and the second time one of the stored keys; where nothing is new nothing is enriched.
    assert [p.count("Exchange hashpartitioning") for p in seen] == [1, 2]
    stored = sinks.current(spark, table)
    assert "SortMergeJoin" not in stored._jdf.queryExecution().executedPlan().toString()
    assert "_writer" not in stored.columns and stored.count() == 31
