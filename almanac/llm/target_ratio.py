"""Quality rules by a hashed n-gram log-likelihood ratio (operator 5).

Words and word pairs are hashed into ``BUCKETS`` buckets. Two multinomials over
the buckets, one of trusted (target) texts and one of the whole raw corpus, give
each bucket a log ratio; a document's score is the mean over its n-grams, so it
doesn't depend on its length. Documents below ``THRESHOLD``, and those that fail
the base rules, are not kept. Only DataFrame functions are used.

Counting explodes n-grams into a map-side combined sum over buckets: each task
ships at most ``BUCKETS`` rows whatever the skew. Scoring is done within the row
against the array of ratios, which has ``BUCKETS`` numbers at any input size.

Edge cases: a null or empty text has no words, score 0 and fails the base rules
(fewer than 50 words); with no trusted text all ratios are 0; ids that are null
or have no label count in the raw corpus only; repeated rows count each and give
a row each; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, words_of

BUCKETS = 16384
THRESHOLD = -0.05        # mean log ratio (nats per n-gram)
PRIOR = 8 * BUCKETS      # n-grams' worth of the raw multinomial mixed into the trusted one
MIN_WORDS = 50
MAX_REPEATED = 50        # per cent of words within repeated three-word windows
SYMBOLS = r"[#*$%&|<>]"


def buckets_of(words: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all words and all pairs of neighbouring words."""
    def bucket(*parts):
        return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")
    single = F.transform(words, lambda w: bucket(w))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
                       F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda a, b: bucket(a, b))
    return F.concat(single, pairs)


def log_ratios(docs: DataFrame, is_trusted: str, buckets: int = BUCKETS) -> list[float]:
    """Log ratio of the trusted to the raw multinomial for every bucket.

    ``docs`` has ``text`` and a boolean column named by ``is_trusted``.
    """
    counted = (docs.select(F.when(F.col(is_trusted), 1).otherwise(0).cast("long").alias("t"),
                           words_of(F.col("text")).alias("w"))
               .select("t", F.explode(buckets_of(F.col("w"), buckets)).alias("bucket"))
               .groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("trusted")))
    rows = {r.bucket: (r.raw, r.trusted) for r in counted.collect()}     # at most `buckets` rows
    raw, trusted = (sum(v[i] for v in rows.values()) for i in (0, 1))
    if not trusted:
        return [0.0] * buckets
    # p_trusted / p_raw with the raw multinomial as prior; a bucket that no text uses has ratio 0.
    return [math.log((t * raw / r + PRIOR) / (trusted + PRIOR)) if r else 0.0
            for r, t in (rows.get(b, (0, 0)) for b in range(buckets))]


def with_base_rules(docs: DataFrame) -> DataFrame:
    """``docs`` (with text and the array ``__words``) with the struct ``base``."""
    text, words = F.coalesce(F.col("text"), F.lit("")), F.col("__words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Three-word windows as 64-bit hashes; only texts that repeat one are sorted.
    windows = F.when(F.size(words) >= 3, F.zip_with(
        F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
                   F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))),
                   lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        F.slice(words, 3, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda p, c: F.xxhash64(p["a"], p["b"], c))).otherwise(F.array().cast("array<bigint>"))
    out = docs.withColumn("__win", windows).withColumn("__lines", lines)
    repeats = F.size(F.array_distinct("__win")) < F.size("__win")
    placed = F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__placed", F.when(repeats, placed).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>")))
    p = F.col("__placed")
    again = F.filter(p, lambda s, j: (s["h"] == F.get(p, j - 1)["h"]) | (s["h"] == F.get(p, j + 1)["h"]))
    starts = F.sort_array(F.transform(again, lambda s: s["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(i, s["to"])).alias("n"), (i + 3).alias("to")),
        lambda s: s["n"])
    n, repeated = F.size(words).cast("long"), covered.cast("long")
    out = out.withColumn("base", F.struct(
        n.alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"))).drop("__win", "__lines", "__placed")
    return out


def score_documents(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with structs ``base`` and ``quality`` (score, base_failed, kept), which replace
    columns of these names."""
    # One literal: the optimizer folds the cast to an array of len(ratios) doubles.
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    worded = docs.withColumn("__words", words_of(F.col("text")))
    grams = buckets_of(F.col("__words"), len(ratios))
    mean = F.aggregate(grams, F.lit(0.0), lambda s, b: s + F.get(table, b)) / F.greatest(
        F.size("__words") * 2 - 1, F.lit(1))
    out = with_base_rules(worded.withColumn("__score", mean)).drop("__words")
    failed = (F.col("base.n_words") < MIN_WORDS) | (
        F.col("base.n_repeat_words") * 100 > F.col("base.n_words") * MAX_REPEATED)
    return out.withColumn("quality", F.struct(
        F.col("__score").alias("score"), failed.alias("base_failed"),
        (~failed & (F.col("__score") >= threshold)).alias("kept"))).drop("__score")


def op5_target_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the ratio's verdict for every document; trusted: quality label 1."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    good = (read(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 1")
            .select("doc_id", F.lit(True).alias("trusted")).distinct())
    marked = docs.join(good.hint("shuffle_hash"), "doc_id", "left")
    out = score_documents(docs, log_ratios(marked, "trusted"))
    return out.select("doc_id", "base.*", F.col("quality.base_failed").alias("base_failed"),
                      F.col("quality.kept").alias("kept"), F.round("quality.score", 6).alias("score"))
