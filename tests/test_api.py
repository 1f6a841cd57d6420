import datetime as dt
import os
import tempfile

from almanac.api import Archive
from almanac.session import scratch_path

TEXT = ("# [2024-01-01~2024-01-07] 주간 요약\n배추 육묘 관리\n"
        "| 날짜 | 기온 |\n|---|---|\n| 1일 | -3.5 |\n| 2일 | 1.5 (평년 2) |\n"
        "# [2024-01-01~2024-01-07] 기상 전망\n한파 주의\n"
        "# [2024-01-08~2024-01-14] 채소\n배추 수확, 무 저장\n"
        "# [2023-01-09~2023-01-15] 주간 요약\n감자 파종 준비\n")


def test_archive_round_trip(spark):
    d = tempfile.mkdtemp(prefix="almanac-api-")
    with open(os.path.join(d, "w.md"), "w", encoding="utf-8") as f:
        f.write(TEXT)
    archive = Archive.from_markdown(spark, d)
    path = scratch_path(spark, "api-table")
    assert archive.save(path) == 4 and archive.save(path) == 0
    stored = Archive.load(spark, path)
    assert [r[0] for r in stored.week_list(2024, 1).collect()] == [
        "2024-01-01~2024-01-07", "2024-01-08~2024-01-14"]
    assert [r[0] for r in stored.tag_list("crop").collect()] == ["감자", "무", "배추"]
    brief = stored.briefing(dt.date(2025, 1, 2), month=1).collect()
    assert [(r["year"], r["rank"]) for r in brief] == [(2023, 1), (2024, 1), (2024, 2)]
    crop = stored.briefing(dt.date(2025, 1, 2), month=1, crops=["감자"]).collect()
    assert [r["year"] for r in crop] == [2023]
    q = stored.df.filter("title like '%채소%'").select("embedding").first()[0]
    hits = stored.search(q, k=3, threshold=0.0).collect()
    assert hits[0]["score"] > 0.99 and hits[0]["band"] == "강력 추천"
    hy = stored.hybrid(q, "배추 수확", k=2).collect()
    assert hy and hy[0]["fts_score"] > 0
    same = stored.search("배추 수확, 무 저장", k=3, threshold=0.0).collect()
    assert same[0]["title" if "title" in same[0].asDict() else "id"]
    index = scratch_path(spark, "api-index")
    stored.save_text_index(index)
    by_text = [stored.hybrid("배추 수확", k=2, index=i).collect() for i in (index, None)]
    assert by_text[0] == by_text[1] and by_text[0][0]["fts_score"] > 0
    wt = stored.weather_tables().collect()
    assert [r["value"] for r in sorted(wt, key=lambda r: r["row_no"])] == [-3.5, 1.5]
    rep = {r["id"]: r["repaired"] for r in stored.repaired().collect()}
    assert any("| --- | --- |" in v for v in rep.values())


def test_week_entries(spark):
    from almanac.api import week_entries
    from almanac.operators.weeks import weeks_json
    import json
    d = tempfile.mkdtemp(prefix="almanac-api-weeks-")
    with open(os.path.join(d, "w.md"), "w", encoding="utf-8") as f:
        f.write(TEXT)
    rows = [json.loads(r[0]) for r in weeks_json(week_entries(spark, d)).collect()]
    assert [r["id"] for r in rows] == ["2023-01-09~2023-01-15", "2024-01-01~2024-01-07",
                                       "2024-01-08~2024-01-14"]
    assert list(rows[1]["content"]) == ["요약", "기상"]
