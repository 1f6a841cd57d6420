"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read as the next one's
``docs``. All but the last return the columns of ``documents``. ``run`` applies them
to the whole table. No stage has limits of its own; each works on all rows that the
one before it kept, and keeps all of its columns, whatever their names. An empty table
passes through every stage.

SQL can't express language models, similarity groups or the automaton, so
``ORACLE_SQL`` is None and tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import decontaminate, fuzzy_lines, langid, minhash, mixture
from almanac.llm.common import read, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the table's labels (operator 9): those without a letter go, and
    those whose letters are unlike the text of every learned language."""
    found = langid.identify(docs.select(F.struct("*").alias("row"), "text"), langid.fit(docs), into="language")
    return found.where((F.col("language.lang_pred") != "und") & F.col("language.known")).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere; those left without a word by that go (operator 8).

    ``n_chars`` follows the text where lines went.
    """
    rows = fuzzy_lines.dedup_lines(docs.select(F.struct("*").alias("row"), "doc_id", "text"), into="dropped", min_wide=1)
    changed = F.size("dropped") > 0
    kept = rows.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return kept.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles (operator 4)."""
    return minhash.keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of the benchmark stands (operator 10)."""
    benchmark = read(spark, sf_dir, "benchmark", "item_id", "text")
    rows = docs.select(F.struct("*").alias("row"), "text")
    return decontaminate.decontaminate(rows, benchmark, into="scan").where(F.col("scan.n_hit") == 0).select("row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the source mix takes it (operator 7)."""
    return mixture.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus made of all of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
