"""Registered queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Every query reads whole tables from ``sf_dir`` (or fixtures Spark derives from
them) and returns a DataFrame whose column names and types match the SQL in
:mod:`almanac.plans.oracle`: integers as BIGINT, scores rounded to 5 places,
lists rendered with ``', '``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.numbers import number_mean
from ..functions.text import bracket_text, join_list
from ..functions.vectors import fixed_dim
from ..operators import ann, filters, season, stats
from ..operators import fulltext as ft
from ..operators import tables as tb
from ..operators import vectors as vx
from ..operators import weeks as wk
from ..operators.dictionary import dictionary_frame, dictionary_tags
from ..operators.tags import categorize, extract_tags
from ..session import scratch_path
from ..sources import markdown as md
from ..sources import sinks
from ..sources.fixtures import (FIXTURE_CATEGORY_MAP, FIXTURE_TAG_SETS, bulletins,
                                weather_table_texts)
from ..sources.profile import peek, profile_tables
from ..sources.tables import read_table

# Fixed query parameters (the dashboard's test day and defaults).
TODAY = dt.date(2025, 1, 7)
MONTH = 1
YEARS = (2023, 2024, 2025)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def finish(df: DataFrame) -> DataFrame:
    """Normalise output types: small integers to BIGINT, floats to DOUBLE."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# --- E2 briefing ---------------------------------------------------------------

@register("q_briefing")
def q_briefing(spark, sf_dir, view=bulletins):
    b = view(spark, sf_dir)
    out = season.briefing(b, TODAY, month=MONTH, years=YEARS)
    return finish(out.withColumn("tags", join_list("tags")))


# --- Dashboard lists, lookups and tag analytics ----------------------------------


WEEK = "2024-03-04~2024-03-10"


@register("q_briefing_week")
def q_briefing_week(spark, sf_dir, view=bulletins):
    """E2, chosen-week mode: titles containing the week, any-of crop filter,
    target day = the week's start."""
    b = view(spark, sf_dir)
    target = dt.date.fromisoformat(WEEK.split("~")[0])
    out = season.briefing(b, target, week_range=WEEK, crops=["thing", "erble"], years=YEARS)
    return finish(out.withColumn("tags", join_list("tags")))


@register("q_week_list")
def q_week_list(spark, sf_dir, view=bulletins):
    b = view(spark, sf_dir).filter((F.col("year") == 2024) & (F.col("month") == 3))
    return finish(stats.distinct_sorted(b, bracket_text("title"), "week_range"))


@register("q_week_lookup")
def q_week_lookup(spark, sf_dir):
    b = bulletins(spark, sf_dir).filter(F.instr("title", WEEK) > 0)
    out = b.select("id", "year", "title", "content_md", join_list("tags").alias("tags"),
                   bracket_text("title").alias("w_range"))
    return finish(out.orderBy(F.desc("year"), "id"))


@register("q_tag_list")
def q_tag_list(spark, sf_dir, view=bulletins):
    return finish(stats.distinct_elements(view(spark, sf_dir, spread_rows=True), "tags", "tag"))


@register("q_tag_top")
def q_tag_top(spark, sf_dir, view=bulletins):
    return finish(stats.tag_counts(view(spark, sf_dir, spread_rows=True), "tags", k=5))


@register("q_tag_contains")
def q_tag_contains(spark, sf_dir):
    b = bulletins(spark, sf_dir, spread_rows=True).filter((F.instr("content_md", "nicht") > 0)
                                        & F.array_contains("tags", "mente"))
    return finish(stats.count_rows(b))


@register("q_tag_any")
def q_tag_any(spark, sf_dir, view=bulletins):
    b = view(spark, sf_dir, spread_rows=True).filter(filters.any_tag("tags", ["thing", "erble"]))
    return finish(b.select("id", join_list("tags").alias("tags")))


@register("q_tag_nonempty")
def q_tag_nonempty(spark, sf_dir, view=bulletins):
    b = view(spark, sf_dir, spread_rows=True).filter(F.size("tags") > 0)
    return finish(b.select("id", "title", F.size("tags").alias("n_tags")))


@register("q_tag_by_year")
def q_tag_by_year(spark, sf_dir):
    b = stats.explode_list(bulletins(spark, sf_dir, spread_rows=True), "tags", "tag", "year")
    return finish(stats.count_by(b, ["year", "tag"]))


@register("q_category_by_month")
def q_category_by_month(spark, sf_dir):
    return finish(stats.count_by(bulletins(spark, sf_dir), ["month", "category"]))


@register("q_category_top")
def q_category_top(spark, sf_dir):
    return finish(stats.top_counts(bulletins(spark, sf_dir), "category", k=5))


@register("q_category_counts")
def q_category_counts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"], spread_on="doc_id")
    cat = categorize("text", FIXTURE_CATEGORY_MAP, skip_toc=True)
    return finish(stats.top_counts(docs, cat, k=5, key_name="category"))


@register("q_count")
def q_count(spark, sf_dir):
    return finish(stats.count_rows(bulletins(spark, sf_dir)))


# --- Predicates over documents and bulletins -------------------------------------

@register("q_short_docs")
def q_short_docs(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"], spread_on="doc_id")
    return finish(docs.filter(F.length("text") < 60)
                  .select("doc_id", F.length("text").alias("len")))


@register("q_special_chars")
def q_special_chars(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"], spread_on="doc_id")
    return finish(docs.filter(filters.contains_any("text", ["~", "%"])).select("doc_id"))


@register("q_or_filter")
def q_or_filter(spark, sf_dir, view=bulletins):
    b = view(spark, sf_dir)
    cond = (F.col("month") == 1) & ((F.instr("category", "요약") > 0)
                                    | (F.instr("content_md", "요약") > 0))
    return finish(b.filter(cond).select("id", "category"))


@register("q_fallback_match")
def q_fallback_match(spark, sf_dir, view=bulletins):
    b = view(spark, sf_dir).filter(F.col("month") == 1)
    return finish(filters.fallback_match(b, "category", "요약").select("id", "category", "tier"))


def _header_query(rule):
    def q(spark, sf_dir):
        docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"], spread_on="doc_id")
        return finish(docs.filter(filters.keep_content("text", rule))
                      .select("doc_id", filters.clean_length("text").alias("clean_len")))
    return q


for _rule in filters.HEADER_RULES:
    register(f"q_header_only_{_rule}")(_header_query(_rule))


# --- Priority rules (R1-R3) ----------------------------------------------------------

def _farming(spark, sf_dir, view=bulletins):
    """The bulletins in the second stored layout: string year, ``_`` ids."""
    b = view(spark, sf_dir)
    return b.select(F.col("id").alias("pk"),
                    F.replace("week_range", F.lit("~"), F.lit("_")).alias("week_id"),
                    F.col("year").cast("string").alias("year"), "month", "category",
                    F.col("content_md").alias("content"))


def _priority_query(near):
    def q(spark, sf_dir, view=bulletins):
        f = _farming(spark, sf_dir, view).filter((F.col("month") == MONTH) & (F.col("year") == "2025"))
        out = season.with_priority(f.select("pk", "week_id", "year", "category"),
                                   "week_id", "year", "category", TODAY, near)
        return finish(out.select("pk", "week_id", "category", "priority", "reason")
                      .orderBy("priority", "pk"))
    return q


register("q_priority_strict")(_priority_query(None))
register("q_priority_near")(_priority_query(7))


@register("q_reject_reasons")
def q_reject_reasons(spark, sf_dir, view=bulletins):
    f = _farming(spark, sf_dir, view).filter((F.col("month") == MONTH) & (F.col("year") == "2025"))
    out = (season.with_priority(f, "week_id", "year", "category", TODAY, 7, reason=None)
           .withColumn("reasons", filters.reject_reasons("content", "category", "priority"))
           .select("pk", "category", "priority", join_list("reasons").alias("reasons"),
                   (F.size("reasons") == 0).alias("kept")))
    return finish(out)


@register("q_recent")
def q_recent(spark, sf_dir, view=bulletins):
    f = _farming(spark, sf_dir, view).filter(F.col("month") == MONTH)
    return finish(stats.latest(f.select("pk", "year", "category"), 150,
                               [F.desc("year"), F.asc("pk")]))


@register("q_summary_exists")
def q_summary_exists(spark, sf_dir):
    f = _farming(spark, sf_dir).filter(F.col("month") == MONTH)
    return finish(stats.exists_flag(f, F.instr("category", "요약") > 0, ["year"], "has_summary"))


# --- Text functions ---------------------------------------------------------------



@register("q_clean_text")
def q_clean_text(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"], spread_on="doc_id")
    return finish(docs.select("doc_id", tx.clean_markdown("text").alias("clean")))


@register("q_embed_text")
def q_embed_text(spark, sf_dir, view=bulletins):
    b = view(spark, sf_dir, spread_rows=True)
    return finish(b.select(
        "id",
        tx.embed_text("title", "content_md").alias("embed_text"),
        F.length(tx.tag_search_range("title", "content_md")).alias("search_len")))


@register("q_title_parts")
def q_title_parts(spark, sf_dir, view=bulletins):
    b = view(spark, sf_dir)
    w = tx.bracket_text("title")
    start = tx.part(w, "~", 1)
    return finish(b.select(
        "id", w.alias("w_range"), start.alias("start"), tx.part(w, "~", 2).alias("end"),
        tx.after_last("title", "]").alias("clean_title"),
        F.substring(start, 1, 4).alias("year_str"),
        F.substring(start, 6, 2).try_cast("int").alias("month_num")))


@register("q_tags_extract")
def q_tags_extract(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"], spread_on="doc_id")
    return finish(docs.select("doc_id", *[
        join_list(extract_tags("text", tags)).alias(f"tags_{cls}")
        for cls, tags in FIXTURE_TAG_SETS.items()]))


@register("q_tags_dictionary")
def q_tags_dictionary(spark, sf_dir):
    """F1 with the dictionary as a table, joined instead of put into a regex."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"], spread_on="doc_id")
    found = dictionary_tags(docs, ["doc_id"], "text", dictionary_frame(spark, FIXTURE_TAG_SETS), list(FIXTURE_TAG_SETS))
    return finish(found.select("doc_id", *[join_list(f"tags_{cls}").alias(f"tags_{cls}") for cls in FIXTURE_TAG_SETS]))


def number_cells(spark, sf_dir):
    """Cells written the way bulletin tables write them: a sign, a range and a
    parenthesised normal, e.g. ``-3~6.55 (평년 2)``."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "user_id", "value"], spread_on="event_id")
    return ev.select("event_id", F.format_string(
        "-%d~%s (평년 %d)", F.pmod("user_id", F.lit(7)), F.col("value").cast("string"),
        F.pmod("event_id", F.lit(5))).alias("cell"))


@register("q_number_mean")
def q_number_mean(spark, sf_dir):
    cells = number_cells(spark, sf_dir)
    return finish(cells.select("event_id", F.round(number_mean("cell"), 5).alias("mean")))


# --- Markdown files, week entries, ingest -------------------------------------------



def rendered_bulletins(spark, sf_dir) -> str:
    """The bulletin fixture as markdown files (one folder per year) on the
    shared scratch folder, written once per application."""
    from ..sources.fixtures import ID_BLOCK, materialized

    def write(path):
        # Blocks of ids put a week's sections in several files.
        src = bulletins(spark, sf_dir).withColumn("part", F.floor(F.col("id") / ID_BLOCK))
        md.render_markdown(src, path, partition_by=("year", "part"))

    return materialized(spark, sf_dir, "bulletins-md", write)


@register("q_sections")
def q_sections(spark, sf_dir):
    sec = md.read_sections(spark, rendered_bulletins(spark, sf_dir), glob="*.txt")
    return finish(sec.select("year", "month", "title", "content_md"))


@register("q_weeks_flat")
def q_weeks_flat(spark, sf_dir):
    files = md.read_files(spark, rendered_bulletins(spark, sf_dir), glob="*.txt")
    return finish(wk.flat_week_rows(wk.week_sections(files), per_file=True))


@register("q_weeks_json")
def q_weeks_json(spark, sf_dir):
    files = md.read_files(spark, rendered_bulletins(spark, sf_dir), glob="*.txt")
    weeks = wk.to_weeks(wk.week_sections(files), per_file=True)
    out = scratch_path(spark, "weeks-json")
    sinks.write_json_lines(weeks.drop("file"), out)
    return spark.read.text(out).select(F.col("value").alias("json"))


@register("q_ingest_idempotent")
def q_ingest_idempotent(spark, sf_dir):
    """Ingest, the same again, then the files moved to another folder with some
    sections corrected and new ones in between: every section once, as it is last."""
    from ..sources.fixtures import ID_BLOCK, materialized

    def write_changed(path):
        src = bulletins(spark, sf_dir).withColumn("part", F.floor(F.col("id") / ID_BLOCK))
        fixed = F.when(F.col("id") % 97 == 0, F.concat("content_md", F.lit("\n정정"))).otherwise(F.col("content_md"))
        new = src.filter(F.col("id") % 101 == 0).withColumns({
            "title": F.concat(F.lit("# ["), "week_range", F.lit("] 신규")),
            "content_md": F.concat(F.lit("추가 "), F.col("id").cast("string")), "id": -F.col("id") - 1})
        md.render_markdown(src.withColumn("content_md", fixed).unionByName(new), path, partition_by=("year", "part"))

    def rows(src):
        # The writer's own file names are random; a file is known by its folders here.
        name = F.regexp_extract("file", "(year=[^/]*/part=[^/]*)/", 1)
        return sinks.section_rows(md.read_sections(spark, src, glob="*.txt"), name)

    table = scratch_path(spark, "farm-info")
    first, changed = rendered_bulletins(spark, sf_dir), materialized(
        spark, sf_dir, "bulletins-changed", write_changed)
    for src in (first, first, changed):              # the second must add nothing
        sinks.ingest(spark, rows(src), table, enrich=sinks.tagged)
    stored = sinks.current(spark, table)
    return finish(stored.select("year", "month", "title", "content_md", F.col("revision").cast("long").alias("revision")))


@register("q_stream_ingest")
def q_stream_ingest(spark, sf_dir):
    from ..streaming.ingest import run_ingest
    src = rendered_bulletins(spark, sf_dir)
    table, ckpt = scratch_path(spark, "farm-stream"), scratch_path(spark, "stream-ckpt")
    for _ in range(2):                        # the second run finds nothing new
        q = run_ingest(spark, src, table, ckpt, glob="*.txt")
        q.awaitTermination()
    stored = spark.read.parquet(table)
    return finish(stored.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"),
                                                     F.countDistinct("id").alias("n_ids")))


# --- Vector search ------------------------------------------------------------------


QUERY_VEC_ID = 0
SEARCH_TEXT = "Is thing the nicht mente?"


def _embeddings(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])


@register("q_cosine_topk")
def q_cosine_topk(spark, sf_dir):
    emb = _embeddings(spark, sf_dir)
    q = vx.query_vector(emb, "vec_id", QUERY_VEC_ID)
    top = vx.cosine_topk(emb, "embedding", q, k=10, id_col="vec_id")
    return finish(top.select("vec_id", "label", F.round("score", 5).alias("score")))


@register("q_cosine_banded")
def q_cosine_banded(spark, sf_dir):
    emb = _embeddings(spark, sf_dir)
    q = vx.query_vector(emb, "vec_id", QUERY_VEC_ID)
    out = vx.banded_search(emb, "embedding", q, id_col="vec_id")
    return finish(out.select("vec_id", F.round("score", 5).alias("score"), "band"))


@register("q_cosine_batch")
def q_cosine_batch(spark, sf_dir):
    """Top 5 vectors nearest to each label's centroid (blocks of queries, no join)."""
    emb = _embeddings(spark, sf_dir)
    cents = vx.centroids(emb, "embedding", "label").select(
        F.col("label").alias("query_id"), F.col("centroid").alias("query"))
    top = vx.multi_query_topk(emb, "embedding", cents, k=5, id_col="vec_id")
    return finish(top.select(F.col("query_id").alias("label"), "rank", "vec_id",
                             F.round("score", 5).alias("score")))


@register("q_ann_topk")
def q_ann_topk(spark, sf_dir):
    """V6: the ten nearest of every vector whose id is divisible by 50, among all, from a stored index."""
    from ..sources.fixtures import materialized
    emb = _embeddings(spark, sf_dir)
    path = materialized(spark, sf_dir, "ann-index", lambda p: ann.build_pq_index(
        emb, "embedding", "vec_id", p, cells=16, parts=emb.select(F.max(F.size("embedding"))).first()[0] // 2))
    asked = emb.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    top = ann.pq_topk(ann.load_pq_index(spark, path), asked, scratch_path(spark, "ann-search"), k=10)
    return finish(top.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 5).alias("score")))


@register("q_encode")
def q_encode(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"], spread_on="doc_id")
    staged = docs.select("doc_id", tx.embed_text(F.substring_index("text", "\n", 1),
                                                 "text").alias("embed_text"))
    out = vx.encode(staged, "embed_text", dim=64)
    return finish(out.select("doc_id", F.size("embedding").alias("dim"),
                             F.round(vx.norm("embedding"), 5).alias("norm")))


def _letters(col="embedding"):
    return F.array_join(F.transform(col, lambda x: x.cast("long").cast("string")), ",")


@register("q_encode_caller")
def q_encode_caller(spark, sf_dir):
    """V1 with a caller's encoder (letter counts), in Arrow batches."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"], spread_on="doc_id")
    return finish(vx.encode(docs, "text", vx.letter_encoder).select("doc_id", _letters().alias("letters")))


@register("q_search_text")
def q_search_text(spark, sf_dir):
    """Search by text: the query is encoded as the rows were."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"], spread_on="doc_id")
    emb = vx.encode(docs, "text", vx.letter_encoder).select("doc_id", "embedding")
    q = vx.encode_query(spark, SEARCH_TEXT, vx.letter_encoder)
    top = vx.cosine_topk(emb, "embedding", q, k=10, id_col="doc_id")
    return finish(top.select("doc_id", F.round("score", 5).alias("score")))


@register("q_build_embedded")
def q_build_embedded(spark, sf_dir):
    """E1 end to end: sections read, tagged, encoded, stored and read back with their vectors."""
    src, table = rendered_bulletins(spark, sf_dir), scratch_path(spark, "farm-embedded")
    sinks.ingest(spark, sinks.section_rows(md.read_sections(spark, src, glob="*.txt")), table,
                 enrich=lambda rows: vx.encode(sinks.tagged(rows), "embed_text", vx.letter_encoder))
    stored = sinks.current(spark, table)
    return finish(stored.select("year", "month", "title", _letters().alias("letters")))


# --- Full text ------------------------------------------------------------------------

def _docs_index(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"], spread_on="doc_id")
    return ft.build_index(docs, "doc_id", "text")


@register("q_bm25")
def q_bm25(spark, sf_dir):
    s = ft.bm25(spark, _docs_index(spark, sf_dir), SEARCH_TEXT)
    return finish(s.select("doc_id", F.round("bm25", 5).alias("bm25")))


@register("q_bm25_saved")
def q_bm25_saved(spark, sf_dir):
    """The same search against the materialised, bucket-partitioned index."""
    from ..sources.fixtures import materialized
    path = materialized(spark, sf_dir, "text-index",
                        lambda p: ft.save_index(_docs_index(spark, sf_dir), p))
    s = ft.bm25(spark, ft.load_index(spark, path), SEARCH_TEXT)
    return finish(s.select("doc_id", F.round("bm25", 5).alias("bm25")))


@register("q_hybrid")
def q_hybrid(spark, sf_dir):
    emb = _embeddings(spark, sf_dir)
    q = vx.query_vector(emb, "vec_id", QUERY_VEC_ID)
    vec = vx.with_cosine(emb.select(F.col("vec_id").alias("doc_id"), "embedding"),
                         "embedding", q).select("doc_id", "score")
    text = ft.bm25(spark, _docs_index(spark, sf_dir), SEARCH_TEXT)
    top = ft.hybrid(vec, text, "doc_id", k=3)
    return finish(top.select("doc_id", F.round("final_score", 5).alias("final_score"),
                             F.round("score", 5).alias("score"),
                             F.round("fts_score", 5).alias("fts_score")))


@register("q_matched_terms")
def q_matched_terms(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"], spread_on="doc_id")
    m = ft.matched_terms("text", "thing nicht mente a xy")
    return finish(docs.select("doc_id", m.alias("m")).filter(F.size("m") > 0)
                  .select("doc_id", join_list("m").alias("matched")))


# --- Tables in text ---------------------------------------------------------------------



@register("q_table_values")
def q_table_values(spark, sf_dir):
    t = tb.weather_table(weather_table_texts(spark, sf_dir), "table_id", "text")
    return finish(t.select("table_id", "row_no", "col_no", "header", "value", "row_valid"))


@register("q_table_repair")
def q_table_repair(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"], spread_on="doc_id")
    return finish(tb.repair_tables(docs, "doc_id", "text"))


@register("q_table_repair_light")
def q_table_repair_light(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"], spread_on="doc_id")
    return finish(tb.repair_tables_light(docs, "doc_id", "text"))


# --- Profile and vector checks ----------------------------------------------------------


PROFILED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
            "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@register("q_peek")
def q_peek(spark, sf_dir):
    """The first rows of a table in an explicit order."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "n_chars"])
    return finish(peek(docs, 5, [F.asc("doc_id")]))


@register("q_literal_rows")
def q_literal_rows(spark, sf_dir):
    """Literal rows as a table, here names for the categories that are counted."""
    names = spark.createDataFrame([("요약", "summary"), ("기상", "weather"), ("벼", "rice"), ("없음", "none")],
                                  "category string, name string")
    counts = bulletins(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("cnt"))
    return finish(names.join(counts, "category", "left").select(
        "name", F.coalesce("cnt", F.lit(0)).alias("cnt")))


@register("q_bulletin_dir")
def q_bulletin_dir(spark, sf_dir):
    """A folder whose ``json_con`` is preferred to its own files."""
    from ..sources.fixtures import materialized

    def write(path):
        rows = bulletins(spark, sf_dir).select(F.concat("title", F.lit("\n"), md.escape_body(F.col("content_md"))))
        rows.write.text(f"{path}/json_con")
        bulletins(spark, sf_dir).select("title").write.mode("append").text(path)
    folder = materialized(spark, sf_dir, "bulletin-dir", write)
    found = md.split_sections(md.bulletin_dir_files(spark, folder, glob="*.txt", split_on_read=True))
    return finish(found.select("year", "month", "title", "content_md"))


@register("q_profile")
def q_profile(spark, sf_dir):
    return finish(profile_tables(spark, sf_dir, PROFILED))


@register("q_vector_check")
def q_vector_check(spark, sf_dir):
    """the fixed-dimension check the ``FLOAT[n]`` column type implied."""
    emb = _embeddings(spark, sf_dir)
    return finish(emb.groupBy(F.size("embedding").alias("dim"))
                  .agg(F.count(F.lit(1)).alias("n"),
                       F.bool_and(fixed_dim("embedding", 64)).alias("ok")))


# --- Nearest week, summary candidates, monthly keywords ---------------------------------

@register("q_nearest_week")
def q_nearest_week(spark, sf_dir, view=bulletins):
    """Per year, the week of month 1 nearest to today's date."""
    b = view(spark, sf_dir).filter(F.col("month") == MONTH)
    rows = b.select("year", bracket_text("title").alias("w_range"))
    return finish(season.nearest_weeks(rows, TODAY))


@register("q_nearest_week_days")
def q_nearest_week_days(spark, sf_dir, view=bulletins):
    """Per year, the week nearest to every day on which an order was placed."""
    days = read_table(spark, sf_dir, "orders", ["o_orderdate"]).select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    rows = view(spark, sf_dir).select("year", bracket_text("title").alias("w_range"))
    out = season.nearest_weeks_by_day(days, rows)
    return finish(out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "year", "best_week", "best_diff"))


@register("q_summary_candidates")
def q_summary_candidates(spark, sf_dir):
    """P20 + P21 + R1: 2024 rows of month 1 whose category mentions 요약."""
    f = _farming(spark, sf_dir).filter((F.col("month") == MONTH) & (F.col("year") == "2024")
                                       & (F.instr("category", "요약") > 0))
    out = season.with_priority(f.select("pk", "week_id", "year", "category"),
                               "week_id", "year", "category", TODAY)
    return finish(out.select("pk", "week_id", "priority", "reason"))


@register("q_tag_top_by_month")
def q_tag_top_by_month(spark, sf_dir):
    """L9 + the monthly keyword suggestion: the 3 most frequent tags per month."""
    b = bulletins(spark, sf_dir, spread_rows=True)
    counts = stats.count_by(stats.explode_list(b, "tags", "tag", "month"), ["month", "tag"])
    top = stats.head_per_group(counts, ["month"], [F.desc("cnt"), F.asc("tag")], 3, "rank")
    return finish(top)
