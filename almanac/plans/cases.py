"""Rule cases: the queries of the rules over a fixture in which every rule fires.

``case_bulletins`` has the columns of ``bulletins`` and a row for each document.
Contents, headers, weeks, categories and tags follow ``doc_id``: headings of all lengths
with and without a chapter mark, tables of contents, links, Hangul text with
one-character tags and particles, ``~`` and ``%``, undated, blank and malformed weeks,
years outside the known ones, blank and missing tags. The same definition is in SQL below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import as_vector
from ..operators import filters
from ..operators import vectors as vx
from ..operators.dictionary import dictionary_frame, dictionary_tags
from ..operators.tags import TAG_SETS, extract_tags
from ..sources import markdown as md
from ..sources.tables import read_table
from . import oracle, queries

# Fixed fixture: content by doc_id mod 24 (n is a length from 0 to 69); others keep their text.
N = "CAST(floor(doc_id / 24) AS INT) % 70"
CONTENTS = {
    0: f"'### ' || repeat('가', {N})",
    1: f"'### 제1장' || repeat('나', {N})",
    2: f"'## ' || repeat('다', {N})",
    3: f"'목차 ' || repeat('라', {N})",
    4: f"'목 차 ' || repeat('마', {N})",
    5: f"'자세한 [내용 보기](http://a.b/c) 과 [둘](d) | - 본문 *강조* `코드` > 인용 ' || repeat('바', {N})",
    6: "'배를 심고 무가 자란다. 배추와 감자밭, 소는 소나무 아래, 벼 파종 AI 방역'",
    7: "'온도는 3~5도, 습도 50% 이상'",
    8: "'소와 닭이 콩을 먹고, 감은 밀가루와 무우 옆 깨에서 보리밀'",
    9: f"'### 제목 |---|' || repeat('사', {N})",
}
CATEGORIES = ["주간 요약", "기상 전망", "농업정보", "벼", "밭 요약", "채소"]
UNDATED, TOC, NO_PAIR, BAD_DATE, BLANK, NO_TAGS, BLANK_TAG = 10, 11, 12, 13, 14, 15, 16


def case_bulletins(spark: SparkSession, sf_dir: str, spread_rows: bool = False) -> DataFrame:
    """The fixture; same columns as ``bulletins``."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"], spread_on="doc_id" if spread_rows else None)
    k = F.pmod("doc_id", F.lit(24))
    start = F.date_add(F.lit("2022-01-03").cast("date"), (7 * (
        F.pmod("doc_id", F.lit(5)) * 52 + F.pmod(F.floor(F.col("doc_id") / 11), F.lit(6)))).cast("int"))
    content = F.col("text")
    for number, expression in CONTENTS.items():
        content = F.when(k == number, F.expr(expression)).otherwise(content)
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]),
                            (F.pmod(F.floor(F.col("doc_id") / 7), F.lit(6)) + 1).cast("int"))
    span = F.concat_ws("~", F.col("week_start").cast("string"), F.col("week_end").cast("string"))
    week = (F.when(k == NO_PAIR, "2025-01-06").when(k == BAD_DATE, "2025-13-01~2025-01-09").when(k == BLANK, "")
            .otherwise(span))
    title = (F.when(k == UNDATED, "# [날짜 없음] 제목").when(k == TOC, F.concat(F.lit("# ["), span, F.lit("] 목 차")))
             .otherwise(F.concat(F.lit("# ["), F.col("week_range"), F.lit("] "), F.col("category"))))
    words = F.array(F.concat(F.lit("태그"), F.pmod("doc_id", F.lit(9)).cast("string")), F.lit("공통"))
    tags = F.when(k == NO_TAGS, F.lit(None)).when(k == BLANK_TAG, F.array(F.lit(""), F.lit(None))).otherwise(words)
    return (docs.withColumn("week_start", start).withColumn("week_end", F.date_add("week_start", 6))
            .withColumn("week_range", week).withColumn("category", category)
            .select(F.col("doc_id").alias("id"), "week_start", "week_end", "week_range",
                    F.year("week_start").alias("year"), F.month("week_start").alias("month"),
                    "category", content.alias("content_md"), title.alias("title"), tags.alias("tags")))


def _k_case(pairs: dict, other: str) -> str:
    return "CASE doc_id % 24 " + " ".join(f"WHEN {k} THEN {v}" for k, v in pairs.items()) + f" ELSE {other} END"


_SPAN = "strftime(week_start, '%Y-%m-%d') || '~' || strftime(week_end, '%Y-%m-%d')"
CASES = f"""
bulletins AS (
  SELECT doc_id AS id, week_start, week_end, week_range, year(week_start) AS year, month(week_start) AS month, category,
         {_k_case(CONTENTS, 'text')} AS content_md,
         {_k_case({UNDATED: "'# [날짜 없음] 제목'", TOC: f"'# [' || {_SPAN} || '] 목 차'"},
                  "'# [' || week_range || '] ' || category")} AS title,
         {_k_case({NO_TAGS: 'NULL', BLANK_TAG: "['', NULL]"}, "['태그' || (doc_id % 9), '공통']")} AS tags
  FROM (
    SELECT *, {_k_case({NO_PAIR: "'2025-01-06'", BAD_DATE: "'2025-13-01~2025-01-09'", BLANK: "''"}, _SPAN)} AS week_range
    FROM (
      SELECT doc_id, text, week_start, week_start + 6 AS week_end,
             {oracle._list(CATEGORIES)}[CAST(floor(doc_id / 7) AS INTEGER) % 6 + 1] AS category
      FROM (SELECT doc_id, text, DATE '2022-01-03' + CAST(7 * (doc_id % 5 * 52 + CAST(floor(doc_id / 11) AS BIGINT) % 6)
                                                          AS INTEGER) AS week_start FROM documents)))
)"""

QUERIES = {}
SQL = {}

# The queries over bulletins again, over the cases.
for _name in ("q_briefing", "q_tag_list", "q_tag_nonempty", "q_tag_top", "q_or_filter", "q_fallback_match",
              "q_priority_strict", "q_priority_near", "q_reject_reasons", "q_recent", "q_nearest_week", "q_nearest_week_days", "q_embed_text", "q_title_parts"):
    def _query(spark, sf_dir, fn=queries.QUERIES[_name]):
        return fn(spark, sf_dir, view=case_bulletins)
    QUERIES[f"{_name}_cases"] = _query
    SQL[f"{_name}_cases"] = oracle.SQL[_name].replace(oracle.BULLETINS, CASES)


def _register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = f"WITH {CASES}\n{sql}"
        return fn
    return add


def _header(rule):
    def q(spark, sf_dir):
        kept = case_bulletins(spark, sf_dir).filter(filters.keep_content("content_md", rule))
        return kept.select("id", filters.clean_length("content_md").cast("long").alias("clean_len"))
    return q


for _rule, _cond in oracle._HEADER_DROP.items():
    _register(f"q_header_only_{_rule}_cases", f"SELECT id, CAST({oracle._CLEAN_LEN} AS BIGINT) AS clean_len "
              f"FROM (SELECT id, content_md AS text FROM bulletins) WHERE NOT {_cond}")(_header(_rule))


@_register("q_special_chars_cases", "SELECT id FROM bulletins WHERE contains(content_md, '~') OR contains(content_md, '%')")
def q_special_chars(spark, sf_dir):
    return case_bulletins(spark, sf_dir).filter(filters.contains_any("content_md", ["~", "%"])).select("id")


@_register("q_toc_cases", "SELECT id FROM bulletins WHERE contains(content_md, '목차') OR contains(content_md, '목 차')")
def q_toc(spark, sf_dir):
    return case_bulletins(spark, sf_dir).filter(filters.is_toc("content_md")).select("id")


@_register("q_clean_text_cases", f"SELECT id, {oracle.clean_markdown('content_md')} AS clean FROM bulletins")
def q_clean_text(spark, sf_dir):
    return case_bulletins(spark, sf_dir).select("id", tx.clean_markdown("content_md").alias("clean"))


@_register("q_tags_extract_cases")
def q_tags_extract(spark, sf_dir):
    """F1 on all rows. SQL can't leave out tags that another one overlaps; tests hold it against plain Python."""
    rows = case_bulletins(spark, sf_dir)
    return rows.select("id", *[tx.join_list(extract_tags("content_md", tags)).alias(f"tags_{cls}")
                               for cls, tags in TAG_SETS.items()])


@_register("q_tags_dictionary_cases")
def q_tags_dictionary(spark, sf_dir):
    """F1 with the dictionary as a table, on all rows; tests hold it against plain Python."""
    found = dictionary_tags(case_bulletins(spark, sf_dir), ["id"], "content_md", dictionary_frame(spark, TAG_SETS), list(TAG_SETS))
    return found.select("id", *[tx.join_list(f"tags_{cls}").alias(f"tags_{cls}") for cls in TAG_SETS])


@_register("q_sections_cases", f"""
, s AS (SELECT *, {oracle.py_strip('content_md')} AS body FROM bulletins)
SELECT CAST(regexp_extract(title, '\\[(\\d{{4}})-(\\d{{2}})', 1) AS BIGINT) AS year,
       CAST(regexp_extract(title, '\\[(\\d{{4}})-(\\d{{2}})', 2) AS BIGINT) AS month, title, body AS content_md
FROM s WHERE NOT contains(title, '목 차') AND regexp_matches(title, '\\[\\d{{4}}-\\d{{2}}')
""")
def q_sections(spark, sf_dir):
    """Sections with a table of contents or no date in the header go."""
    from ..sources.fixtures import ID_BLOCK, materialized

    def write(path):
        rows = case_bulletins(spark, sf_dir).withColumn("part", F.floor(F.col("id") / ID_BLOCK))
        md.render_markdown(rows, path, partition_by=("year", "part"))
    found = md.read_sections(spark, materialized(spark, sf_dir, "cases-md", write), glob="*.txt")
    return found.select(F.col("year").cast("long"), F.col("month").cast("long"), "title", "content_md")


_NEAR = """, q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
v AS (SELECT vec_id, list_transform(list_zip(CAST(embedding AS DOUBLE[]), (SELECT q FROM q)),
             lambda p: p[2] + p[1] * (vec_id / 3.0::DOUBLE)) AS v FROM embeddings),
top AS (SELECT vec_id, list_cosine_similarity(v, (SELECT q FROM q)) AS s FROM v ORDER BY s DESC NULLS LAST, vec_id LIMIT 10)
SELECT vec_id, round(s, 5) AS score,
       CASE WHEN s >= 0.65 THEN '강력 추천' WHEN s >= 0.50 THEN '관련 있음' ELSE '참고용' END AS band
FROM top WHERE s >= 0.40 ORDER BY s DESC, vec_id LIMIT 5"""


@_register("q_cosine_banded_cases", _NEAR)
def q_cosine_banded(spark, sf_dir):
    """Vectors at growing angles to the query, so that all bands and both limits act."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    q = vx.query_vector(emb, "vec_id", 0)
    near = F.zip_with("embedding", as_vector(q), lambda x, y: y + x.cast("double") * (F.col("vec_id") / F.lit(3.0)))
    out = vx.banded_search(emb.select("vec_id", near.alias("v")), "v", q, id_col="vec_id")
    return out.select("vec_id", F.round("score", 5).alias("score"), "band")
