"""Incremental ingest: markdown files landing in a folder -> section table.

The same section cut as the batch reader, run by Structured Streaming over
the file source; every micro-batch goes through the idempotent batch
``ingest``, so a replayed batch after a failure adds nothing. Progress lives in a checkpoint folder on shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_newlines
from ..operators.vectors import encode
from ..sources.markdown import split_sections
from ..sources.sinks import below, ingest, section_rows, tagged


def file_stream(spark: SparkSession, src_dir: str, glob: str = "*.md") -> DataFrame:
    raw = (spark.readStream.format("text").option("wholetext", True)
           .option("pathGlobFilter", glob).option("recursiveFileLookup", True)
           .load(src_dir))
    return raw.select(F.col("_metadata.file_path").alias("file"),
                      normalize_newlines("value").alias("text"))


def run_ingest(spark: SparkSession, src_dir: str, table_dir: str, checkpoint: str,
               glob: str = "*.md", available_now: bool = True, encoder_factory=None, dim: int = 64):
    """Start the stream; with ``available_now`` it processes what is there and stops.
    Rows are tagged and encoded as ``Archive.from_markdown`` does, into the same table."""
    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        ingest(batch.sparkSession, section_rows(split_sections(batch), below(src_dir)), table_dir,
               enrich=lambda rows: encode(tagged(rows), "embed_text", encoder_factory, dim))

    writer = (file_stream(spark, src_dir, glob).writeStream
              .foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="30 seconds")
    return writer.start()
