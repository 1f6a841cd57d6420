"""Markdown bulletin files: write, find, read and cut into sections.

A bulletin file is a run of sections, each opening with a header line
``# [YYYY-MM-DD~YYYY-MM-DD] title``. Reading uses the whole-text source (one
row per file) and cuts sections with a regex split inside the row, so no
shuffle is needed; for very large single files ``split_on_read=True`` lets
the text source itself split at ``\\n# [`` so one file spreads over many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.computed import with_computed
from ..functions.text import WS, WS_INLINE, normalize_newlines, py_strip
from ..operators.filters import contains_any

DATE = r"\d{4}-\d{2}-\d{2}"
# Week-file header line: ``#``, blanks, ``[d1~d2]``, blanks, title (on a stripped line).
HEADER_LINE = rf"^#{WS_INLINE}*\[({DATE}~{DATE})\]{WS_INLINE}*(.*)$"
# embed-style section boundary: newline, ``#``, any whitespace, then ``[``.
SECTION_BOUNDARY = rf"\n#{WS}*(?=\[)"
# The boundary as files are usually written: at it the text source itself can cut a file.
RECORD_SEP = "\n# ["
# Endings of files that one task must decode from their start.
COMPRESSED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst")
# The table-of-contents marker the section reader skips on.
SECTION_TOC = ["목 차"]


def escape_body(col) -> Column:
    """Prefix a backslash to body lines that would read as section headers."""
    return F.regexp_replace(col, rf"(?md)^({WS_INLINE}*#{WS_INLINE}*\[)", "\\\\$1")


def render_markdown(df: DataFrame, path: str, title: str = "title", body: str = "content_md",
                    order: Sequence[str] = ("week_start", "id"),
                    partition_by: Sequence[str] = ("year",)) -> None:
    """Write sections as markdown text files: one directory and one file per
    value of ``partition_by``, sections sorted by ``order`` inside the file.

    The caller sets the fan-out: add a column such as ``pmod(id, K)`` to
    ``partition_by`` so that no single file holds a hot year or week.
    """
    parts = list(partition_by)
    section = F.concat(F.col(title), F.lit("\n"), escape_body(F.col(body)))
    (df.select(*parts, *order, section.alias("value"))
       .repartition(*parts)
       .sortWithinPartitions(*parts, *order)
       .select(*parts, "value")
       .write.mode("overwrite")
       .partitionBy(*parts)
       .text(path))


def path_exists(spark: SparkSession, pattern: str) -> bool:
    """Driver-side glob through the Hadoop file system of the path."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hpath)
    return found is not None and len(found) > 0


def read_files(spark: SparkSession, path: str, glob: str = "*.md",
               recursive: bool = True, skip_damaged: bool = False) -> DataFrame:
    """One row per file: (file, text), line endings normalised (T5).

    A file that can't be read fails the job; with ``skip_damaged`` it is left out, and
    ``damaged_files`` lists it."""
    # format("text").load(): DataFrameReader.text() would reset wholetext.
    raw = (spark.read.format("text").option("wholetext", True)
           .option("pathGlobFilter", glob)
           .option("recursiveFileLookup", recursive)
           .option("ignoreCorruptFiles", skip_damaged)
           .load(path))
    return raw.select(F.col("_metadata.file_path").alias("file"),
                      normalize_newlines("value").alias("text"))


def damaged_files(spark: SparkSession, path: str, glob: str = "*.md", recursive: bool = True) -> DataFrame:
    """(file) of the files under ``path`` that ``skip_damaged`` leaves out.

    Names come from a listing that opens no file, and what can be read from a read of all."""
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
              .load(path).select(F.col("path").alias("file")))
    read = read_files(spark, path, glob, recursive, skip_damaged=True).select("file", F.length("text").alias("n"))

    def key(column):
        return F.regexp_replace(F.url_decode(F.replace(column, F.lit("+"), F.lit("%2B"))), "^[a-z][a-z0-9+.-]*:/*", "")
    return listed.join(read, key(listed["file"]) == key(read["file"]), "left_anti")


def _mark_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, value) rows in reading order with ``first``: whether the row is its file's first one."""
    last = None
    for batch in batches:
        first = []
        for place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            first.append(place[1] == 0 and place != last)
            last = place
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.bool_())], names=["file", "block", "value", "first"])


def read_records(spark: SparkSession, path: str | list[str], glob: str = "*.md", recursive: bool = True,
                 skip_damaged: bool = False) -> DataFrame:
    """Files cut where a header opens with ``\\n# [``: (file, start, text) with several rows per file.

    No task holds a file, and a large one is spread over many. ``split_sections`` cuts the rows at headers with
    other blanks. Of a damaged file ``skip_damaged`` leaves out what can't be read; a byte order mark is left out."""
    raw = (spark.read.format("text").option("lineSep", RECORD_SEP)
           .option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
           .option("ignoreCorruptFiles", skip_damaged).load(path))
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    rows = rows.mapInArrow(_mark_first, "file string, block long, value string, first boolean")
    # Every record but a file's first lost the separator before it: put "[" back and let
    # split_sections add "# ".
    text = normalize_newlines("value")
    # Blocks of a file don't overlap and ids grow within a task: an order within the file.
    return rows.select("file", F.struct(F.col("block").alias("_block"), F.monotonically_increasing_id().alias("_record")).alias("start"),
                       F.when(F.col("first"), text).otherwise(F.concat(F.lit("["), text)).alias("text"))


def bulletin_dir_files(spark: SparkSession, directory: str, glob: str = "*.md", split_on_read: bool = False) -> DataFrame:
    """Prefer ``<dir>/json_con/<glob>``, else ``<dir>/<glob>`` (path choice on the driver).

    With ``split_on_read`` the rows are those of ``read_records``, for ``split_sections``; compressed files,
    which no reader can split, stay whole."""
    preferred = f"{directory.rstrip('/')}/json_con"
    folder = preferred if path_exists(spark, f"{preferred}/{glob}") else directory
    if not split_on_read:
        return read_files(spark, folder, glob, recursive=False, skip_damaged=True)
    records = read_records(spark, folder, glob, recursive=False, skip_damaged=True)
    folder, endings = folder.rstrip("/"), "{" + ",".join(f"*{e}" for e in COMPRESSED) + "}"
    if not (path_exists(spark, f"{folder}/{endings}") and path_exists(spark, f"{folder}/{glob}")):
        return records
    start = F.struct(F.lit(0).cast("long").alias("_block"), F.lit(0).cast("long").alias("_record"))
    whole = read_files(spark, f"{folder}/{glob}", endings, recursive=False, skip_damaged=True).select(
        "file", start.alias("start"), "text")
    packed = F.col("file").rlike("(" + "|".join(re.escape(e) for e in COMPRESSED) + r")\z")
    return records.where(~packed).unionByName(whole)


def split_sections(files: DataFrame) -> DataFrame:
    """S1 + F5-F7 + P16 + P17: cut each file into sections.

    Blank sections are skipped; the header is the first line of the stripped
    section (``# `` added when the split removed it), the body the rest; a
    header with the table-of-contents marker or without ``[YYYY-MM`` is dropped.
    Output: file, section_no, section_order, year, month, title, content_md. The
    order is (``start``, section): ``start`` is 0, or ``files``' own column of the
    name where a file comes in several rows.
    """
    start = F.col("start") if "start" in files.columns else F.lit(0).cast("long")
    parts = files.select("file", start.alias("_start"),
                         F.posexplode(F.split("text", SECTION_BOUNDARY, -1)).alias("section_no", "section"))
    parts = with_computed(parts, _s=py_strip("section")).drop("section").filter(F.col("_s") != "")
    header = F.substring_index("_s", "\n", 1)
    body = F.when(F.instr("_s", "\n") > 0,
                  F.expr("substring(_s, instr(_s, '\n') + 1)")).otherwise(F.lit(""))
    parts = (parts.withColumn("_h", header).withColumn("content_md", body)
             .withColumn("title", F.when(F.col("_h").startswith("#"), F.col("_h"))
                         .otherwise(F.concat(F.lit("# "), F.col("_h")))))
    ym = r"\[(\d{4})-(\d{2})"
    return (parts.filter(~contains_any("title", SECTION_TOC))
            .filter(F.regexp_extract("title", ym, 1) != "")
            .select("file", "section_no", F.struct("_start", "section_no").alias("section_order"),
                    F.regexp_extract("title", ym, 1).cast("int").alias("year"),
                    F.regexp_extract("title", ym, 2).cast("int").alias("month"),
                    "title", "content_md"))


def read_sections(spark: SparkSession, path: str, glob: str = "*.md",
                  split_on_read: bool = False) -> DataFrame:
    """Markdown files under ``path`` -> one row per dated section.

    ``split_on_read`` reads with ``lineSep='\\n# ['`` so a single huge file is
    split across tasks (see ``read_records``).
    """
    if not split_on_read:
        return split_sections(read_files(spark, path, glob))
    out = split_sections(read_records(spark, path, glob))
    return out.drop("section_no").withColumn("section_no", F.lit(None).cast("int"))
