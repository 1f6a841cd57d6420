"""Full-text search: postings index (V5), BM25 (V3), hybrid score (V4) and
matched query words (V7).

Index layout: postings ``(term, doc_id, tf, dl)``, document frequencies
``(term, df)`` and one row of corpus statistics ``(n_docs, avgdl)``. Saved,
postings and frequencies are partitioned by a hash bucket of the term, so a
query reads only the buckets of its own terms (partition pruning) and the
corpus statistics are never recomputed per query.

BM25 (the original's settings are not recorded): Unicode letter/number
tokens, k1 = 1.2, b = 0.75, idf = ln((N - df + 0.5) / (df + 0.5) + 1),
distinct query terms; a document without any query term has no score (NULL).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.2, 0.75
# Saved indexes: about this many tokens per term bucket.
TOKENS_PER_BUCKET = 5_000_000


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def term_bucket(term, buckets: int) -> Column:
    return F.pmod(F.xxhash64(_c(term)), F.lit(buckets)).cast("int")


@dataclass
class TextIndex:
    postings: DataFrame   # term, doc_id, tf, dl (+ bucket when saved)
    doc_freq: DataFrame   # term, df (+ bucket when saved)
    stats: DataFrame      # one row: n_docs, avgdl
    bucketed: bool = False
    tokens: DataFrame | None = None   # doc_id, dl, _t (lazy indexes only)
    buckets: int | None = None        # term buckets of a saved index


def build_index(docs: DataFrame, id_col: str, text_col: str) -> TextIndex:
    """V5 (lazy): the index as DataFrames over ``docs``."""
    tok = docs.select(F.col(id_col).alias("doc_id"), tokens(text_col).alias("_t"))
    tok = tok.withColumn("dl", F.size("_t"))
    from .stats import explode_list
    postings = (explode_list(tok, "_t", "term", "doc_id", "dl")
                .groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf")))
    # count("tf") keeps the postings subplan identical, so its exchange is reused.
    doc_freq = postings.groupBy("term").agg(F.count("tf").alias("df"))
    stats = tok.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    return TextIndex(postings, doc_freq, stats, tokens=tok)


def save_index(index: TextIndex, path: str, buckets: int | None = None) -> None:
    """V5 (materialised): write postings, document frequencies and statistics
    under ``path``. The number of term buckets follows the corpus size (about
    ``TOKENS_PER_BUCKET`` tokens each) unless given, and is stored with the
    statistics so queries hash terms the same way."""
    stats = index.stats.first()
    if buckets is None:
        tokens = (stats["n_docs"] or 0) * (stats["avgdl"] or 0.0)
        buckets = int(max(1, -(-tokens // TOKENS_PER_BUCKET)))
    spark = index.postings.sparkSession
    # Range-partition on (bucket, term, doc): each task writes one or a few
    # bucket folders, and a bucket holding a very frequent term is split over
    # several tasks instead of landing in one.
    (index.postings.withColumn("bucket", term_bucket("term", buckets))
     .repartitionByRange("bucket", "term", "doc_id")
     .sortWithinPartitions("bucket", "term", "doc_id")
     .write.mode("overwrite").partitionBy("bucket")
     .parquet(f"{path}/postings"))
    # Document frequencies from the written postings (already bucketed), not
    # from another pass over the text.
    written = spark.read.parquet(f"{path}/postings")
    (written.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/doc_freq"))
    spark.createDataFrame([(stats["n_docs"], stats["avgdl"], buckets)],
                          "n_docs long, avgdl double, buckets int") \
        .write.mode("overwrite").parquet(f"{path}/stats")


def load_index(spark: SparkSession, path: str) -> TextIndex:
    stats = spark.read.parquet(f"{path}/stats")
    return TextIndex(spark.read.parquet(f"{path}/postings"),
                     spark.read.parquet(f"{path}/doc_freq"),
                     stats, bucketed=True, buckets=int(stats.first()["buckets"]))


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """Distinct tokens of the query, cut by the same Spark expression as the
    documents (one literal row, evaluated once)."""
    row = spark.range(1).select(F.array_distinct(tokens(F.lit(query)))).first()
    return list(row[0])


def bm25(spark: SparkSession, index: TextIndex, query: str, k1: float = K1,
         b: float = B, name: str = "bm25") -> DataFrame:
    """V3: (doc_id, score) for documents holding at least one query term."""
    terms = query_terms(spark, query)
    if not terms:
        return index.postings.select("doc_id", F.lit(None).cast("double").alias(name)).limit(0)
    postings, doc_freq, stats = index.postings, index.doc_freq, index.stats
    if index.bucketed:
        wanted = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string")
                  .select(term_bucket("t", index.buckets)).distinct().collect()]
        postings = postings.filter(F.col("bucket").isin(wanted))
        doc_freq = doc_freq.filter(F.col("bucket").isin(wanted))
    if index.tokens is not None:
        # Lazy index: tokenise the corpus once. Each document keeps only its
        # length and its query-term tokens; that small table is checkpointed
        # to the shared folder and feeds the statistics, the postings and the
        # document frequencies, so the text is scanned a single time.
        from ..session import checkpoint_dir
        checkpoint_dir(spark)
        wanted_terms = F.array(*[F.lit(t) for t in terms])
        per_doc = index.tokens.select("doc_id", "dl", F.filter(
            "_t", lambda t: F.array_contains(wanted_terms, t)).alias("_q")).checkpoint(eager=True)
        stats = per_doc.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
        hits = per_doc.select("doc_id", "dl", F.explode("_q").alias("term"))
        postings = hits.groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
        doc_freq = postings.groupBy("term").agg(F.count("tf").alias("df"))
    postings = postings.filter(F.col("term").isin(terms))
    # At most len(terms) rows: safe to broadcast.
    dfq = F.broadcast(doc_freq.filter(F.col("term").isin(terms)).select("term", "df"))
    n = stats.select(F.col("n_docs").cast("double")).scalar()
    avgdl = stats.select("avgdl").scalar()
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (
        F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    return (postings.join(dfq, "term").groupBy("doc_id").agg(F.sum(part).alias(name)))


def hybrid(vector_scores: DataFrame, text_scores: DataFrame, id_col: str = "doc_id",
           w_vec: float = 0.7, w_text: float = 0.3, k: int | None = 3,
           missing: str = "drop", text_col: str = "bm25") -> DataFrame:
    """V4: ``w_vec * score + w_text * bm25``. With ``missing='drop'`` a row
    without a text score has no total and is dropped (as a NULL sum is);
    ``missing='zero'`` counts it as 0. Top ``k`` by the total."""
    how = "inner" if missing == "drop" else "left"
    j = vector_scores.join(text_scores, id_col, how)
    fts = F.col(text_col) if missing == "drop" else F.coalesce(F.col(text_col), F.lit(0.0))
    out = (j.withColumn("fts_score", fts)
           .withColumn("final_score", w_vec * F.col("score") + w_text * F.col("fts_score"))
           .filter(F.col("final_score").isNotNull()))
    out = out.orderBy(F.desc("final_score"), F.asc(id_col))
    return out.limit(k) if k else out


def matched_terms(content, query: str) -> Column:
    """V7: whitespace-separated query words longer than one character that
    occur in the content (the words the result view highlights)."""
    words = [w for w in query.split() if len(w) > 1]
    arr = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    return F.filter(arr, lambda w: F.contains(_c(content), w))
