"""Deterministic fixture views derived from the given tables.

``bulletins`` turns ``documents`` into dated weekly bulletin sections; it is a
pure projection (no shuffle), so it scales with ``documents``. The same
definition is written in SQL in ``almanac.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tags import token_tags
from .tables import read_table, spread_small

# Fixed fixture parameters.
FIRST_MONDAY = "2023-01-02"
# Rendered markdown: a section goes to the file of its year and id block.
ID_BLOCK = 4 * 157
N_WEEKS = 157
# Class word by doc_id mod 12.
CLASS_WORDS = ["요약", "요약", "기상", "기상", "벼", "밭작물", "채소", "과수", "화훼",
               "특용작물", "축산", "양봉"]
# Frequent words of the generated prose, used as a tag dictionary / query.
FIXTURE_WORDS = ["thatin", "ononst", "inoran", "hehely", "orantion", "thing", "erble",
                 "nicht", "mente"]
# Tag classes over the same words (plus two one-character tags) for F1.
FIXTURE_TAG_SETS = {
    "a": ["thatin", "ononst", "inoran", "orantion"],
    "b": ["hehely", "thing", "erble", "z"],
    "c": ["nicht", "mente", "q"],
}
# Ordered category dictionary for R4 on the generated prose.
FIXTURE_CATEGORY_MAP = {
    "alpha": ["thatin", "ononst"],
    "beta": ["hehely", "nicht"],
    "gamma": ["mente", "erble"],
    "delta": ["thing"],
}


def bulletins(spark: SparkSession, sf_dir: str, spread_rows: bool = False) -> DataFrame:
    """Weekly bulletin rows derived from ``documents`` (FIXTURES.md section 2).

    ``spread_rows`` is for queries that do heavy per-row text work (tags,
    whole-text regexes): see :func:`almanac.sources.tables.read_table`."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"],
                      spread_on="doc_id" if spread_rows else None)
    start = F.date_add(F.lit(FIRST_MONDAY).cast("date"),
                       (F.pmod(F.col("doc_id"), F.lit(N_WEEKS)) * 7).cast("int"))
    words = F.array(*[F.lit(w) for w in CLASS_WORDS])
    return (docs
            .withColumn("week_start", start)
            .withColumn("week_end", F.date_add("week_start", 6))
            .withColumn("week_range", F.concat_ws("~", F.col("week_start").cast("string"),
                                                  F.col("week_end").cast("string")))
            .select(
                F.col("doc_id").alias("id"),
                "week_start", "week_end", "week_range",
                F.year("week_start").alias("year"),
                F.month("week_start").alias("month"),
                F.element_at(words, (F.pmod(F.col("doc_id"), F.lit(12)) + 1).cast("int"))
                 .alias("category"),
                F.col("text").alias("content_md"),
            )
            .withColumn("title", F.concat(F.lit("# ["), F.col("week_range"), F.lit("] "),
                                          F.col("category")))
            .withColumn("tags", token_tags("content_md", FIXTURE_WORDS)))


def weather_tables(spark: SparkSession, sf_dir: str, rows_per_table: int = 20) -> DataFrame:
    """Markdown weather tables rendered from ``events``.

    Events are cut into blocks of ``rows_per_table`` consecutive ``event_id``s,
    so a table never holds more than that many rows however the events are
    distributed over users. Each block becomes one text:
    a caption, ``| 날짜 | 기온 | 강수 |``, a separator and one row per event, the
    temperature cell carrying a parenthesised normal that the parser must drop.
    """
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "value", "props"])
    row = F.format_string(
        "| %s | %s (평년 %d) | %s |",
        F.date_format("ts", "yyyy-MM-dd HH:mm"),
        F.col("value").cast("string"),
        F.pmod(F.col("event_id"), F.lit(9)),
        F.coalesce(F.get_json_object("props", "$.k"), F.lit("-")))
    blocks = (ev.withColumn("table_id", F.floor(F.col("event_id") / rows_per_table))
              .groupBy("table_id")
              .agg(F.array_sort(F.collect_list(F.struct("event_id", row.alias("line"))))
                   .alias("rows")))
    header = "주간 기상 자료\n| 날짜 | 기온 | 강수 |\n|---|---|---|\n"
    return blocks.select(
        "table_id",
        F.concat(F.lit(header),
                 F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("text"))


# Derived fixtures written once per Spark application and sf_dir, so queries
# measure the operator rather than the fixture build.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def materialized(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Return the shared-folder path of fixture ``name``, writing it with
    ``write(path)`` the first time in this application."""
    from ..session import scratch_path
    key = (spark.conf.get("spark.app.id", "app"), sf_dir, name)
    if key not in _WRITTEN:
        path = scratch_path(spark, name)
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def weather_table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``weather_tables`` written once to parquet and read back."""
    path = materialized(spark, sf_dir, "weather-tables",
                        lambda p: weather_tables(spark, sf_dir).write.parquet(p))
    return spread_small(spark, spark.read.parquet(path), "table_id")
