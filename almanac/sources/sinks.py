"""Sinks: JSON Lines, partitioned section tables and idempotent ingest."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tags import TAG_SETS, tag_columns
from ..functions.text import embed_text, tag_search_range
from ..session import scratch_path
from .markdown import path_exists


# Tasks that write one month's rows, and so the most files a batch adds to a month.
WRITERS_PER_MONTH = 8


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, UTF-8, non-ASCII unescaped."""
    df.write.mode(mode).json(path)


# What a stored section is known by, wherever in its file it stands. ``file_name`` is the
# path below the archive's root, so equal names in two folders are two files and the
# whole archive can be moved.
IDENTITY = ("file_name", "title", "occurrence")


def below(root: str, file: str = "file") -> Column:
    """The part of a file's path below ``root``, or its name where it isn't below it (a root that is a file)."""
    folder = "/" + re.sub(r"^[a-z][a-z0-9+.-]*:/*", "", root).strip("/") + "/"
    path = F.concat(F.lit("/"), F.regexp_replace(F.url_decode(F.replace(F.col(file), F.lit("+"), F.lit("%2B"))),
                                                 "^[a-z][a-z0-9+.-]*:/*", ""))
    return F.when(F.instr(path, folder) > 0, F.substring_index(path, folder, -1)).otherwise(F.substring_index(path, "/", -1))


def _writer() -> Column:
    """Which of a month's writers a section goes to, by its header line."""
    return F.pmod(F.xxhash64("title"), F.lit(WRITERS_PER_MONTH)).cast("int")


def identified(sections: DataFrame, file_name: Column | None = None) -> DataFrame:
    """Sections with ``file_name``, ``occurrence``, ``id`` and ``version``.

    A section is known by its file, its header line and its number among equal headers
    of that file, so new sections and either way of reading leave it alone; ``id`` hashes
    that identity. ``version`` is a hash of the body, by which a corrected section shows.
    ``file_name`` is an expression over ``file``, by default the name without its folders;
    where several folders may have files of one name, give ``below(root)`` or a name of
    the source's own."""
    writer = F.col("_writer") if "_writer" in sections.columns else _writer()
    order = Window.partitionBy("year", "month", writer, "file_name", "title").orderBy("file", "section_order")
    name = F.regexp_extract("file", r"([^/]*)\z", 1) if file_name is None else file_name
    named = sections.withColumn("file_name", name)
    version = F.col("_digest") if "_digest" in sections.columns else F.sha2("content_md", 256)
    return (named.withColumn("occurrence", F.row_number().over(order) - 1)
            .withColumn("id", F.xxhash64(*IDENTITY))
            .withColumn("version", version).drop("_digest"))


def section_rows(sections: DataFrame, file_name: Column | None = None) -> DataFrame:
    """Sections with their identity and version, clustered for storing.

    One shuffle of the texts: the window, the look at the stored keys and the
    partitioned write all use this clustering, whose column ``_writer`` ``ingest`` drops.
    The versions are hashed before it, so that what asks for keys and versions shuffles no text."""
    hashed = sections.withColumns({"_writer": _writer(), "_digest": F.sha2("content_md", 256)})
    clustered = hashed.repartition("year", "month", "_writer")
    return identified(clustered, file_name).drop("section_order")


def tagged(rows: DataFrame, tag_sets=TAG_SETS) -> DataFrame:
    """Rows with their tags and the text the encoder would see."""
    df = tag_columns(rows.withColumn("_search", tag_search_range("title", "content_md")),
                     "_search", tag_sets)
    return df.withColumn("embed_text", embed_text("title", "content_md")).drop("_search")


def farm_rows(sections: DataFrame, tag_sets=TAG_SETS, file_name: Column | None = None) -> DataFrame:
    """E1 without the encoder: sections -> rows to store."""
    return tagged(section_rows(sections, file_name).drop("_writer"), tag_sets)


def ingest(spark: SparkSession, rows: DataFrame, path: str, partition_by=("year", "month"),
           enrich: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Append to a parquet table partitioned by year and month the sections
    that it lacks, and corrected ones as their next ``revision``; returns how many.

    Only keys and versions of the stored rows are read; they are compared in full, not by a
    hash, first without the texts. The batch is written once, straight from the plan that
    computes it: it reads the files that the table has now, which appending doesn't change. ``enrich`` adds columns (tags, vectors) to
    the rows that are written, and to no others."""
    parts, keys = list(partition_by), [*partition_by, *IDENTITY]
    rows = rows if "_writer" in rows.columns else rows.withColumn("_writer", _writer())
    # A write that died before its first file left a folder without data files.
    if path_exists(spark, f"{path}/{parts[0]}=*"):
        stored = spark.read.schema(stored_schema(rows, parts)).option("basePath", path).parquet(f"{path}/{parts[0]}=*").select(
            *keys, F.lit(True).alias("_kept"), F.col("version").alias("_version"), F.col("revision").alias("_revision"))
        stored = stored.withColumn("_writer", _writer()).repartition(*parts, "_writer")
        same = Window.partitionBy(*parts, "_writer", *IDENTITY)

        def lacking(new: DataFrame) -> DataFrame:
            # The stored keys come to the rows, clustered as ``section_rows`` does: a join on all keys would deal the texts anew.
            both = new.unionByName(stored, allowMissingColumns=True).select(
                *new.columns, "_kept", F.max_by("_version", "_revision").over(same).alias("_stored"),
                F.max("_revision").over(same).alias("_last")).where(F.col("_kept").isNull())
            both = both.filter(F.col("_stored").isNull() | (F.col("_stored") != F.col("version")))
            return both.withColumn("revision", F.coalesce(F.col("_last") + 1, F.lit(0))).drop("_kept", "_stored", "_last")

        # Where nothing is new, keys and versions tell it without the texts.
        if lacking(rows.select(*keys, "version", "_writer")).isEmpty():
            return 0
        batch = lacking(rows)
    else:
        batch = rows.withColumn("revision", F.lit(0))
    batch = batch.drop("_writer")
    if enrich is not None:
        batch = enrich(batch)
    seen = Observation()
    batch.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").partitionBy(*parts).parquet(path)
    return int(seen.get["rows"])


def stored_schema(rows: DataFrame, parts: list[str]) -> T.StructType:
    """What ``ingest`` needs of the stored table, stated so that nothing is inferred from its files."""
    kinds = {c: rows.schema[c].dataType for c in (*IDENTITY, "version", *parts)}
    return T.StructType([*[T.StructField(c, k) for c, k in kinds.items()], T.StructField("revision", T.IntegerType())])


def current(spark: SparkSession, path: str, partition_by=("year", "month")) -> DataFrame:
    """The stored table with each section in its last revision."""
    # Only the partitions' folders: what a failed write left beside them doesn't count.
    stored = spark.read.option("basePath", path).parquet(f"{path}/{list(partition_by)[0]}=*")
    keys = [*partition_by, *IDENTITY]
    last = F.max("revision").over(Window.partitionBy(*keys))
    old = stored.select(*keys, "revision", last.alias("_last")).where("revision < _last").drop("_last")
    # Written, so that the plan knows that they are few: then the stored texts aren't shuffled.
    gone = scratch_path(spark, "superseded")
    old.write.parquet(gone)
    return stored.dropna(subset=keys).join(spark.read.schema(old.schema).parquet(gone), [*keys, "revision"], "left_anti")
