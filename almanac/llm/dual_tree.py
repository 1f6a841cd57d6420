"""Ranked lexical search of many items over all documents by dual-tree pruning (operator 11).

A document is a sparse vector of contributions, one per term that any item has; an
item is a vector of term weights; the score is their product. Both sides are trees.
Documents are sorted by their strongest terms, so like ones stand together, and cut
into shelves of ``SHELF`` documents and batches of ``BATCH``; a node holds, per term, the
largest contribution below it. Items are sorted likewise and cut into blocks, groups
of ``GROUP`` and items; a node holds, per term, the largest weight below it. The product
of two nodes bounds every score below them, and a pair of nodes is left out if that
bound is less than the weakest ``k``-th score that any of its items already has (or
equal, when all of its documents come after that one's id). So nothing that could
enter a result is left out.

The first pass walks, for every item, the shelf of its largest bound, which gives the
items good ``k``-th scores; the second walks all pairs of item block and shelf whose
bound still reaches them. A pair of (item block, shelf) is one group of a cogroup: it
holds ``SHELF`` documents, cut down to the items' terms, and one block of items, whatever
the size of the tables; nothing is broadcast by hand and nothing passes the driver but counts.

Edge cases: null and wordless texts count for nothing and are never found; null,
empty and wordless items get no rows; rows of one item id are one item with the terms
of all, a null item id is skipped; repeated documents are ranked as rows of their own, and
a null doc_id comes after all others; fewer than ``k`` documents above 0 are all returned;
empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, written
from .decontaminate import TABLE
from .positions import numbered

K = 10
SHELF, BATCH = 4096, 64          # documents
BLOCK, GROUP = 128, 8            # items
CHUNK = 256                      # texts whose terms are in Python at a time
NO_ID = np.iinfo(np.int64).max   # the id of documents without one: after all others
EXACT = 2 ** 53                  # doubles hold all integers below


def term_counts(text: str | None) -> Counter:
    """Terms ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a whole text as bytes, A-Z lower-cased, with their numbers."""
    return Counter((text or "").encode("utf-8", "surrogatepass").translate(TABLE).split())


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a text -> one row per term, and one with an empty word per text that has any."""
    for whole in batches:
        for at in range(0, whole.num_rows, CHUNK):
            batch = whole.slice(at, CHUNK)
            found = [term_counts(t) for t in batch.column("text").to_pylist()]
            for c in found:
                if c:
                    c[b""] = 0
            sizes = [len(c) for c in found]
            keys = batch.drop_columns("text").take(pa.array(np.repeat(np.arange(len(found)), sizes)))
            n = np.repeat(np.array([sum(c.values()) for c in found], np.int64), sizes)
            yield pa.RecordBatch.from_arrays(
                [*keys.columns, pa.array(n), pa.array([w for c in found for w in c], pa.binary()),
                 pa.array([x for c in found for x in c.values()], pa.int64())],
                [*keys.schema.names, "n", "word", "tf"])


def postings(texts: DataFrame) -> DataFrame:
    """``texts`` with (n, word, tf) in place of text: a row per term, see ``count_terms``."""
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return texts.mapInArrow(count_terms, f"{keys}, n long, word binary, tf long")


def ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column as (row of each element, elements)."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()


def reaches(bound, first, score, last):
    """Whether documents from id ``first`` on, of scores up to ``bound``, may come before (``score``, ``last``)."""
    return (bound > score) | ((bound == score) & (first < last))


class Tops:
    """The best (score, id, index) of each item, and the ``k``-th of them as far as known."""

    def __init__(self, k: int, score: np.ndarray, last: np.ndarray):
        self.k, self.score, self.last = k, score, last
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in score]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, index: np.ndarray) -> None:
        better = np.flatnonzero((scores > 0) & reaches(scores, ids, self.score[item], self.last[item]))
        if not len(better):
            return
        best = self.best[item] + [(-int(scores[j]), int(ids[j]), int(index[j])) for j in better]
        self.best[item] = best = sorted(best)[:self.k]
        # Only a full list has a k-th; an earlier, better bound stands.
        if len(best) == self.k and reaches(-best[-1][0], best[-1][1], self.score[item], self.last[item]):
            self.score[item], self.last[item] = -best[-1][0], best[-1][1]


def dual_tree(k: int, items: np.ndarray, rows: np.ndarray, cols: np.ndarray, values: np.ndarray,
              ids: np.ndarray, score: np.ndarray, last: np.ndarray) -> tuple[Tops, int]:
    """Walk items (a row of weights each) against sparse documents; (best of each item, scores computed)."""
    n, width = len(ids), items.shape[1]
    n_batches = -(-n // BATCH)
    highest = np.zeros((n_batches, width), items.dtype)
    np.maximum.at(highest, (rows // BATCH, cols), values)
    first = np.minimum.reduceat(ids, np.arange(0, n, BATCH))
    starts = np.arange(0, len(items), GROUP)
    bounds = np.maximum.reduceat(items, starts, axis=0) @ highest.T           # groups x batches
    cut = np.searchsorted(rows, np.arange(0, n_batches + 1) * BATCH)
    tops, scored = Tops(k, score, last), 0
    for b in np.argsort(-bounds.max(axis=0), kind="stable"):
        weakest = np.minimum.reduceat(tops.score, starts)
        latest = np.maximum.reduceat(np.where(tops.score == np.repeat(weakest, GROUP)[:len(items)], tops.last, -1), starts)
        groups = np.flatnonzero(reaches(bounds[:, b], first[b], weakest, latest))
        if not len(groups):
            continue
        live = (starts[groups][:, None] + np.arange(GROUP)).ravel()
        live = live[live < len(items)]
        live = live[reaches(items[live] @ highest[b], first[b], tops.score[live], tops.last[live])]
        if not len(live):
            continue
        here = slice(cut[b], cut[b + 1])
        index = np.arange(b * BATCH, min(n, (b + 1) * BATCH))
        dense = np.zeros((width, len(index)), items.dtype)
        dense[cols[here], rows[here] - index[0]] = values[here]
        scores = items[live] @ dense
        scored += scores.size
        for item, of in zip(live, scores, strict=True):
            tops.add(item, of, ids[index], index)
    return tops, scored


def walker(k: int):
    def walk(docs: pa.Table, asks: pa.Table) -> pa.Table:
        """Documents of a shelf against the items of a block that may find something there."""
        docs, asks = docs.sort_by("row"), asks.sort_by("at")
        of, terms = ragged(asks["terms"])
        weights = ragged(asks["weights"])[1]
        width, cols = np.unique(terms, return_inverse=True)
        rows, doc_terms = ragged(docs["terms"])
        values = ragged(docs["values"])[1]
        at = np.minimum(np.searchsorted(width, doc_terms), max(len(width) - 1, 0))
        known = width[at] == doc_terms
        most = int(np.bincount(of, weights).max() * values.max()) + 1
        dtype = np.float64 if most < EXACT else np.int64
        items = np.zeros((asks.num_rows, len(width)), dtype)
        items[of, cols] = weights
        ids = docs["doc_id"].fill_null(NO_ID).to_numpy()
        tops, _ = dual_tree(k, items, rows[known], at[known], values[known].astype(dtype), ids,
                            asks["score"].to_numpy().copy(), asks["last"].to_numpy().copy())
        item = np.repeat(np.arange(len(tops.best)), [len(b) for b in tops.best])
        found = [x for b in tops.best for x in b]
        return pa.table({"item_id": asks["item_id"].take(pa.array(item)),
                         "doc_id": docs["doc_id"].take(pa.array([i for _, _, i in found], pa.int64())),
                         "score": pa.array([-s for s, _, _ in found], pa.int64())})
    return walk


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each item with their rank."""
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def item_vectors(asked: DataFrame, weights: DataFrame) -> DataFrame:
    """(block, at, item_id, terms, weights) of (item_id, term): items of common terms stand together."""
    rows = (asked.join(weights, "term").groupBy("item_id")
            .agg(F.array_sort(F.collect_list(F.struct("term", F.col("w").alias("weight")))).alias("v"),
                 F.min(F.struct("w", "term")).alias("key")))
    rows = rows.select("item_id", F.col("v.term").alias("terms"), F.col("v.weight").alias("weights"), "key",
                       F.lit("all").alias("tree"))
    return numbered(rows, "tree", ["key", "item_id"], "search-items").select(
        F.floor(F.col("position") / BLOCK).alias("block"), F.col("position").alias("at"), "item_id", "terms", "weights")


def doc_vectors(flat: DataFrame, weights: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(shelf, row, doc_id, terms, values) of the postings: documents alike in their strongest terms stand together."""
    m = F.expr(f"10 + (90 * n * {n_docs}L) div {n_terms}L")
    value = F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")
    points = flat.withColumn("m", m).join(weights, "term").withColumn("value", value)
    rows = points.groupBy("nth", "doc_id").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("w") * F.col("value")).alias("rank"), "term", "value"))).alias("v"))
    rows = rows.select("nth", "doc_id", F.col("v.term").alias("terms"), F.col("v.value").alias("values"),
                       F.slice("v.term", 1, 2).alias("key"), F.lit("all").alias("tree"))
    return numbered(rows, "tree", ["key", "nth"], "search-documents").select(
        F.floor(F.col("position") / SHELF).alias("shelf"), F.col("position").alias("row"), "doc_id", "terms", "values")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs`` (doc_id, text) for every one of ``items`` (item_id, text)."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, doc_id long, score long"
    asked = written(postings(items.where("item_id IS NOT NULL").select("item_id", "text"))
                    .where(F.length("word") > 0).select("item_id", "word").distinct(), "search-asked")
    words = numbered(written(asked.select("word").distinct().withColumn("all", F.lit("all")), "search-words"),
                     "all", ["word"], "search-vocabulary").select("word", F.col("position").cast("int").alias("term"))
    # The empty word, which every document with a term has, carries the document's length.
    words = written(words.unionByName(spark.createDataFrame([(bytearray(), -1)], words.schema)), "search-terms")
    texts = docs.select(F.monotonically_increasing_id().alias("nth"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    flat = written(postings(texts).join(words, "word").drop("word"), "search-postings")
    n_docs, n_terms = flat.where("term = -1").agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return best_of(spark.createDataFrame([], schema), k).select("item_id", "rank", "doc_id", "score")
    weight = F.floor(F.lit(1000) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weights = written(flat.where("term >= 0").groupBy("term").agg(F.count("*").alias("df"))
                      .select("term", weight.alias("w")).where("w > 0"), "search-weights")
    item_rows = item_vectors(asked.join(words, "word"), weights)
    doc_rows = doc_vectors(flat, weights, n_docs, n_terms)

    # Bounds of (item, shelf) from the largest values by term.
    highest = doc_rows.select("shelf", F.explode(F.arrays_zip("terms", "values")).alias("v")).groupBy(
        "shelf", F.col("v.terms").alias("term")).agg(F.max("v.values").alias("most"))
    firsts = doc_rows.groupBy("shelf").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first"))
    points = item_rows.select("block", "item_id", F.explode(F.arrays_zip("terms", "weights")).alias("v")).select(
        "block", "item_id", F.col("v.terms").alias("term"), F.col("v.weights").alias("w"))
    bounds = written(highest.join(points, "term").groupBy("block", "item_id", "shelf")
                     .agg(F.sum(F.col("w") * F.col("most")).alias("bound")).join(firsts, "shelf"), "search-bounds")

    def walked(asks: DataFrame) -> DataFrame:
        """Results of (block, item_id, shelf, score, last)."""
        pairs = asks.select("block", "shelf").distinct()
        left = doc_rows.join(pairs, "shelf").groupBy("block", "shelf")
        right = item_rows.join(asks, ["block", "item_id"]).groupBy("block", "shelf")
        return written(left.cogroup(right).applyInArrow(walker(k), schema), "search-found")

    seeds = written(bounds.groupBy("block", "item_id").agg(F.max_by("shelf", F.struct("bound", "shelf")).alias("shelf")),
                    "search-seeds")
    none = F.lit(-1).cast("long")
    found = walked(seeds.select("*", F.lit(0).cast("long").alias("score"), none.alias("last")))
    kth = best_of(found, k).where(F.col("rank") == k).select("item_id", "score", F.coalesce(
        "doc_id", F.lit(NO_ID)).alias("last"))
    rest = bounds.join(seeds, ["block", "item_id", "shelf"], "left_anti").join(kth, "item_id", "left").withColumns(
        {"score": F.coalesce("score", F.lit(0).cast("long")), "last": F.coalesce("last", none)})
    rest = written(rest.where((F.col("bound") > F.col("score")) | (
        (F.col("bound") == F.col("score")) & (F.col("first") < F.col("last")))).drop("bound", "first"), "search-rest")
    return best_of(found.unionByName(walked(rest)), k).select("item_id", "rank", "doc_id", "score")


def op11_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return search(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


OP11_SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
postings AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM sizes),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, totals GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
scored AS (
  SELECT a.item_id, p.doc_id,
    sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * s.n * t.docs) // t.words))))::BIGINT AS score
  FROM asked a JOIN weights w USING (term) JOIN postings p USING (term) JOIN sizes s USING (doc_id), totals t
  GROUP BY a.item_id, p.doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
