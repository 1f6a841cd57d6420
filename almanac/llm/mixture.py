"""Mixing sources to target weights (operator 7).

Tokens are aggregated per source, each source gets a repetition rate
``target / source size``, and every document is emitted ``floor(rate)`` times
plus one hash-seeded Bernoulli copy whose probability is the fraction of the rate.

Targets: sources in code-point order (null last) get the weights in turn; they
share ``budget`` times all sizes; a target stops at ``max_rate`` times its
source's size and the excess is shared again by weight until none is above. That
end state is ``target = min(max_rate * size, weight * level)`` with one ``level``
for all, found from running sums over the sources sorted by
``max_rate * size / weight``.

Everything is DataFrame operations. The tables over sources have one row per
source; documents meet them through a join on (source, salt), so a source with a
third of all rows is dealt over ``SALTS`` keys.

Edge cases: a null text has size 0 and is never copied beyond what its source's
rate says (it takes 0 words either way); a source whose size is 0 gets target 0
and rate 0; null sources form one source; the draw is of (id, hash of the text), so texts
under a null or repeated id draw apart, and repeated rows, equal in both, each count and
draw the same copy; an empty table gives an empty result; other columns stay, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, read, written

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MAX_RATE = 2.0
SEED = "mix-1"
SALTS = 32


def draw_key(doc_id: Column, text: Column) -> Column:
    """What a document's draw is seeded with: its id and, as ids may be null or repeat, its text."""
    none = F.lit("null")
    return F.concat(F.coalesce(doc_id.cast("string"), none), F.lit(":"), F.coalesce(F.md5(text), none))


def bernoulli(key: Column, seed: str, p: Column) -> Column:
    """1 with probability ``p``, fixed by ``key`` and ``seed``; else 0."""
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8)
    return F.when(F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0) < p, 1).otherwise(0).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS,
                   budget: float = BUDGET, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size) -> the same with ``target`` in tokens.

    Works on one row per source; the windows never see documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    cap = F.lit(max_rate) * F.col("source_size")
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(budget) * F.sum("source_size").over(everything)
             - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    # Sources are capped up to the first (by cap / weight) that its level leaves uncapped;
    # taking later ones as capped only lowers the level, so the first has the largest.
    open_level = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    return (sizes.withColumn("w", w).withColumn("cap", cap).withColumn("level", level)
            .withColumn("open", F.max(open_level).over(everything))
            .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("open") * F.col("w"), F.col("cap"))))
            .select("source", "source_size", "target"))


def mix_plan(docs: DataFrame, size: Column, key: Column, *, weights: Sequence[float] = WEIGHTS,
             budget: float = BUDGET, max_rate: float = MAX_RATE, seed: str = SEED,
             into: str = "mix") -> DataFrame:
    """``docs`` with a struct column ``into`` (size, source_size, target, copies), in place of one
    of this name. ``key`` seeds a document's draw."""
    sized = docs.select(F.struct("*").alias("doc"), F.col("source").alias("of"), size.alias("size"), key.alias("key"),
                        F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("part"))
    totals = sized.groupBy("of").agg(F.sum("size").alias("source_size")).withColumnRenamed("of", "source")
    targets = written(source_targets(totals, weights, budget, max_rate), "mix-targets").select(
        "source", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    joined = sized.join(targets, F.col("of").eqNullSafe(F.col("source")) & (F.col("part") == F.col("salt")), "left")
    return joined.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c != into], F.struct(
        "size", "source_size", "target", (whole + bernoulli(F.col("key"), seed, rate - whole)).alias("copies")).alias(into))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed table: every document of ``docs`` as often as the mix takes it."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text")
    planned = mix_plan(rows, n_words(F.col("text")), draw_key(F.col("doc_id"), F.col("text")), **options)
    copies = F.sequence(F.lit(1).cast("long"), F.col("mix.copies"))
    return planned.where(F.col("mix.copies") > 0).select("row", F.explode(copies)).select("row.*")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the mix that every document gets."""
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text")
    # Texts are read once: sizes are written, and both passes read the narrow table.
    sizes = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("n"), draw_key(
        F.col("doc_id"), F.col("text")).alias("draw")), "mix-sizes")
    m = mix_plan(sizes, F.col("n"), F.col("draw"))
    return m.select("doc_id", F.col("mix.size").alias("size"), F.col("mix.source_size").alias("source_size"),
                    F.col("mix.target").alias("target"), (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null') AS draw,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3
              WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
         2.0::DOUBLE * source_size AS cap
  FROM per_source),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
opened AS (
  SELECT *, max(CASE WHEN level * w <= cap THEN level END) OVER () AS open FROM levels),
targets AS (
  SELECT source, source_size, least(cap, coalesce(open * w, cap)) AS target FROM opened),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('mix-1:' || d.draw), 1, 8) AS BIGINT)
           / 4294967296.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
