"""Secret scans over an incremental blob ledger (operator 3).

Every version of every path is content-addressed (SHA-256 of its text). The
ledger, a Parquet table, holds one row per (address, rule version) with the
spans found. ``update`` scans only the pairs that the ledger lacks, one text per
address, and ``findings`` joins the ledger back to all paths. Running ``update``
again, or on a table that shares blobs with an earlier one, scans nothing twice.

Shuffles: addresses are narrow rows, and copies meet in a map-side combined
aggregate that names one row per address. Its text is fetched by row key, not by
address, so thousands of copies of one text never share a partition.

Edge cases: a null text is the empty text; empty texts have no spans; repeated
rows share one scan and each get the spans; null ids are kept, one result per
row; an empty table writes nothing and returns nothing; other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import read, written

RULES_VERSION = "secrets-1"
BASE_KINDS = ("assign", "access", "hex")
# The kinds in report order, their patterns, the length to reach
# and the group whose length counts. ``hex`` and ``access`` state the length in
# the pattern: a run is matched whole, so a shorter one can't hide a longer one.
RULES = (
    ("assign", r"(?ia:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 1),
    ("access", r"AKIA[A-Z0-9]{14,}", 18, 0),
    ("hex", r"[0-9a-f]{16,}", 16, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)
SPANS = "array<struct<kind:string,start:long,end:long>>"
LEDGER = f"address binary, rules string, spans {SPANS}"


def spans_of(text: str, rules=RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every match, by start and then kind as listed."""
    found = []
    for order, (kind, pattern, least, group) in enumerate(rules):
        for m in re.finditer(pattern, text):
            if len(m.group(group)) >= least:
                found.append((m.start(), order, m.end(), kind))
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def scanner(rules):
    @F.pandas_udf(SPANS)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t, rules)]
                             for t in batch], dtype=object)
    return scan


def address(text):
    """Content address of a text column: SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class BlobLedger:
    """Findings by (address, rule version), stored as Parquet at ``path``."""

    def __init__(self, spark: SparkSession, path: str, rules=RULES, version: str = RULES_VERSION):
        self.spark, self.path, self.rules, self.version = spark, path, rules, version

    def table(self) -> DataFrame:
        """The stored rows of this rule version; none before the first update."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(hadoop):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path).where(F.col("rules") == self.version)

    def update(self, versions: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Scan the blobs of ``versions`` that have no row yet; return (key, address) of all rows."""
        row_key = F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__key")
        paths = written(versions.select(F.col(key), row_key, address(F.col(text)).alias("address")), "addresses")
        unseen = (paths.groupBy("address").agg(F.min("__key").alias("__key"))
                  .join(self.table().select("address"), "address", "left_anti"))
        blobs = versions.select(row_key, address(F.col(text)).alias("address"),
                                F.coalesce(F.col(text), F.lit("")).alias("__text"))
        scanned = (blobs.join(unseen.hint("shuffle_hash"), ["__key", "address"], "left_semi")
                   .select("address", F.lit(self.version).alias("rules"),
                           scanner(self.rules)("__text").alias("spans")))
        # Rows equal in key and text give equal findings; one stays.
        scanned.dropDuplicates(["address"]).write.mode("append").parquet(self.path)
        return paths.drop("__key")

    def findings(self, paths: DataFrame) -> DataFrame:
        """Every path with the spans of its blob."""
        return paths.join(self.table().select("address", "spans"), "address", "left")


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document through a ledger in the shared folder."""
    ledger = BlobLedger(spark, scratch_path(spark, "secret-ledger"))
    paths = ledger.update(read(spark, sf_dir, "documents", "doc_id", "text"))
    spans = F.coalesce("spans", F.array().cast(SPANS))
    found = ledger.findings(paths).withColumn("spans", spans)

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def listed(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
