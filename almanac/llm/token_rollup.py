"""Token counts as delta-maintained rollups (operator 2).

A batch of changes (inserted, revised or deleted documents) becomes signed
deltas: minus what the document counted for before, plus what it counts for now,
per tokenizer version. Deltas are written per batch, together with their sums by
source, language and tokenizer version; totals are the sums of the batches' sums,
so reading them never touches documents again.

Commits are idempotent: a batch id has one folder, which counts once Spark's
``_SUCCESS`` marker is in it. A batch that is already committed is not computed
again, one that died halfway is written anew, and a retry can't count twice.

Only changed documents are tokenized. They meet their earlier deltas in a join on
``doc_id``, which is unique in either side, so no key is hot; sums combine before the
shuffle and have one row per (source, language, tokenizer version).

Edge cases: a null text counts 0 tokens but one document; null sources and
languages are groups of their own; several rows of one id in a batch are one
document, the one with the largest (deleted, source, language, counts) stands;
rows with a null id can't be revised: each counts when inserted and is ignored as
a deletion; deleting an unknown id changes nothing; an empty batch commits
nothing but its id; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import read

VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: how the vocabularies cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PART = 1_000_000
GROUP = ("source", "lang", "tokenizer")
COUNTS = "array<struct<tokenizer:string,tokens:long>>"
DELTA = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"


def parts_of(text: str) -> Iterator[str]:
    """Parts of a long text, cut where a token always ends: before a lone space."""
    at = 0
    while len(text) - at > PART:
        cut = re.compile(r"(?<=\S) (?=\S)").search(text, at + PART)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def load_vocabulary(path: str) -> tuple[str, bytes]:
    """(version, file content); the version is the file's name and a digest of it."""
    with open(path, "rb") as f:
        content = f.read()
    return f"{os.path.basename(path).split('.')[0]}@{hashlib.sha256(content).hexdigest()[:8]}", content


def counter(spark: SparkSession, vocabularies: Sequence[str]):
    """UDF text -> token count under each vocabulary (files of bounded size, broadcast)."""
    shared = spark.sparkContext.broadcast([load_vocabulary(v) for v in vocabularies])

    @F.pandas_udf(COUNTS)
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        encoders = [(version, tiktoken.Encoding(version, pat_str=PATTERN, special_tokens={}, mergeable_ranks={
            base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}))
            for version, content in shared.value]
        for batch in batches:
            yield pd.Series([[{"tokenizer": v, "tokens": sum(
                len(e.encode_ordinary(p)) for p in parts_of(t)) if isinstance(t, str) else 0}
                for v, e in encoders] for t in batch], dtype=object)
    return count


class TokenRollup:
    """Token totals stored under ``path``, changed by batches."""

    def __init__(self, spark: SparkSession, path: str, vocabularies: Sequence[str] = VOCABULARIES):
        self.spark, self.path, self.vocabularies = spark, path.rstrip("/"), vocabularies

    def _committed(self) -> list[str]:
        """Folder names of the batches that count."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/sums")
        files = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        folders = [s.getPath() for s in files.listStatus(top)] if files.exists(top) else []
        return [p.getName() for p in folders if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def _read(self, kind: str, schema: str) -> DataFrame:
        # A batch counts once its sums are complete, which are written after its deltas.
        paths = [f"{self.path}/{kind}/{name}" for name in self._committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch (doc_id, source, lang, text and, if present, deleted); False if it was applied before."""
        if f"batch={batch_id}" in self._committed():
            return False
        deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in changes.columns else F.lit(False)
        now = changes.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), F.col("lang"), deleted.alias("deleted"),
            F.when(~deleted, counter(self.spark, self.vocabularies)("text")).alias("counts"))
        state = F.struct("deleted", "source", "lang", "counts")
        keyed = now.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(state).alias("s")).select("doc_id", "s.*")
        every = keyed.unionByName(now.where("doc_id IS NULL"))
        plus = (every.where("NOT deleted").select("doc_id", "source", "lang", F.explode("counts").alias("c"))
                .select("doc_id", "source", "lang", "c.tokenizer", F.lit(1).cast("long").alias("docs"), "c.tokens"))
        before = (self._read("deltas", DELTA).where("doc_id IS NOT NULL").groupBy("doc_id", *GROUP)
                  .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0"))
        # Only ids are needed of the batch here: texts aren't tokenized a second time.
        ids = changes.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        minus = before.join(ids, "doc_id", "left_semi").withColumn("docs", -F.col("docs")).withColumn(
            "tokens", -F.col("tokens"))
        deltas = f"{self.path}/deltas/batch={batch_id}"
        minus.unionByName(plus).write.mode("overwrite").parquet(deltas)
        (self.spark.read.schema(DELTA).parquet(deltas).groupBy(*GROUP)
         .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
         .write.mode("overwrite").parquet(f"{self.path}/sums/batch={batch_id}"))
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) of all committed batches."""
        sums = self._read("sums", "source string, lang string, tokenizer string, docs long, tokens long")
        return (sums.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                .where("docs <> 0"))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after loading all documents; the load is committed twice and counts once."""
    rollup = TokenRollup(spark, scratch_path(spark, "token-rollup"))
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    for _ in range(2):
        rollup.commit("load", docs)
    return rollup.totals()
