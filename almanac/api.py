"""A facade over a stored bulletin table, for day-to-day use.

    archive = Archive.from_markdown(spark, "/data/bulletins", glob="*.md")
    archive.save(path)                       # idempotent append, year/month partitions
    archive = Archive.load(spark, path)
    archive.week_list(2024, 3)               # DataFrame of week ranges
    archive.briefing(date(2025, 1, 7), month=1, crops=["배추"])
    archive.search(query_vector, k=10)       # banded semantic search

Every method returns a lazy DataFrame built from the operators in this package.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import bracket_text
from .operators import fulltext, season, stats, tables, vectors, weeks
from .operators.tags import TAG_SETS
from .sources import markdown, sinks


class Archive:
    """A section table: id, year, month, title, content_md, tags_<class>...,
    embed_text and (optionally) embedding."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def from_markdown(cls, spark: SparkSession, path: str, glob: str = "*.md",
                      tag_sets: Mapping[str, Sequence[str]] = TAG_SETS,
                      encoder_factory: Callable | None = None, dim: int = 64,
                      split_on_read: bool = False) -> Archive:
        """Read markdown files, cut sections, tag them and encode them
        (a caller-supplied encoder, or the built-in hashed one).
        ``split_on_read`` spreads a very large single file over many tasks
        (see :func:`almanac.sources.markdown.read_sections`)."""
        sections = markdown.read_sections(spark, path, glob, split_on_read=split_on_read)
        rows = sinks.farm_rows(sections, tag_sets, sinks.below(path))
        rows = vectors.encode(rows, "embed_text", encoder_factory, dim)
        return cls(rows)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Archive:
        return cls(sinks.current(spark, path))

    def save(self, path: str) -> int:
        """Append the rows not stored yet and corrected ones; returns how many were written."""
        return sinks.ingest(self.df.sparkSession, self.df, path)

    def week_list(self, year: int, month: int) -> DataFrame:
        """A5: distinct week ranges of a month, ascending."""
        rows = self.df.filter((F.col("year") == year) & (F.col("month") == month))
        return stats.distinct_sorted(rows, bracket_text("title"), "week_range")

    def tag_list(self, cls: str = "crop") -> DataFrame:
        """Every tag of one class, ascending."""
        return stats.distinct_elements(self.df, f"tags_{cls}", "tag")

    def tag_counts(self, cls: str = "crop", k: int | None = 5) -> DataFrame:
        """A4: the most frequent tags of one class."""
        return stats.tag_counts(self.df, f"tags_{cls}", k)

    def briefing(self, target: dt.date, month: int | None = None,
                 week_range: str | None = None, crops: Sequence[str] = (),
                 years: Sequence[int] | None = None, per_year: int = 4,
                 cls: str = "crop") -> DataFrame:
        """Per year, the items of the week nearest ``target`` (see
        :func:`almanac.operators.season.briefing`)."""
        return season.briefing(self.df, target, month=month, week_range=week_range,
                               crops=crops, years=years, per_year=per_year,
                               tags_col=f"tags_{cls}")

    def _vector(self, query, encoder_factory: Callable | None, dim: int) -> Sequence[float]:
        if not isinstance(query, str):
            return query
        return vectors.encode_query(self.df.sparkSession, query, encoder_factory, dim)

    def search(self, query: str | Sequence[float], k: int = 10, threshold: float = 0.40,
               shown: int = 5, encoder_factory: Callable | None = None, dim: int = 64) -> DataFrame:
        """Top ``k`` by cosine, then the threshold, then the first ``shown``,
        each with its relevance band. ``query`` is a text, encoded as the archive's
        rows were, or a vector."""
        return vectors.banded_search(self.df, "embedding", self._vector(query, encoder_factory, dim),
                                     "id", k, threshold, shown)

    def save_text_index(self, path: str) -> None:
        """V5: the content's text index, for :meth:`hybrid`."""
        fulltext.save_index(fulltext.build_index(self.df, "id", "content_md"), path)

    def hybrid(self, query: str | Sequence[float], query_text: str | None = None, k: int = 3,
               w_vec: float = 0.7, w_text: float = 0.3, index: str | None = None,
               encoder_factory: Callable | None = None, dim: int = 64) -> DataFrame:
        """E3 hybrid: ``w_vec * cosine + w_text * BM25`` over the content, top ``k``;
        rows without any query term drop out. ``query`` is a text (then also the
        BM25 query) or a vector; ``index`` is the path of a saved text index,
        without which the whole content is tokenised."""
        spark = self.df.sparkSession
        words = query_text if query_text is not None else query
        if not isinstance(words, str):
            raise ValueError("a query vector needs query_text")
        built = fulltext.load_index(spark, index) if index else fulltext.build_index(
            self.df, "id", "content_md")
        text = fulltext.bm25(spark, built, words).withColumnRenamed("doc_id", "id")
        vec = vectors.with_cosine(self.df.select("id", "embedding"), "embedding",
                                  self._vector(query, encoder_factory, dim)).select("id", "score")
        return fulltext.hybrid(vec, text, "id", w_vec, w_text, k)

    def weather_tables(self) -> DataFrame:
        """T-A: weather tables in the content, as long rows."""
        return tables.weather_table(self.df, "id", "content_md")

    def repaired(self, light: bool = False) -> DataFrame:
        """T-B (or T-C with ``light``): the content with its tables rebuilt."""
        fn = tables.repair_tables_light if light else tables.repair_tables
        return fn(self.df, "id", "content_md")


def week_entries(spark: SparkSession, directory: str, glob: str = "*.md",
                 per_file: bool = True) -> DataFrame:
    """Markdown files of a folder (``json_con`` preferred) as week entries
    with a category map; ``weeks.weeks_json`` turns them into JSON lines."""
    files = markdown.bulletin_dir_files(spark, directory, glob)
    return weeks.to_weeks(weeks.week_sections(files), per_file=per_file)
