"""V6: approximate neighbours of many queries, by cells and product quantisation.

Index. Centres come from spherical k-means on a bounded sample; every vector is stored,
in the cell of its nearest centre. What the vector differs from its centre (the residual)
is cut into ``parts`` subvectors, and each is replaced by the nearest of ``CODES`` code words
fitted on the sample: one byte a part, stored beside the vector, with the cell's largest
angle to its centre.

Search. Queries are a table. A query takes the nearest cells until they hold
``MARGIN`` * k vectors, at least ``probes`` cells, and then every further cell that by its
largest angle could hold something nearer than the k-th best found so far. In a cell, all
codes are scored by table look-up; only the ``rerank`` * k best of a query have their vectors
read and are scored by them. (query, cell) pairs are met by a join on the cell, so neither the queries
nor the vectors pass through the driver; centres and code words do, whose number is the
caller's choice and doesn't grow with the table.

Zero, missing and differently long vectors have no cosine: they are stored in cell
``NO_CELL`` and never found. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, norm
from .vectors import NO_CELL, fit_centres

CODES = 256
MARGIN = 4
PARTS = 8                 # groups that a cell is dealt into, so that a full one isn't one task's
SAMPLE = 50_000
STORED = "id long, vec array<float>, unit double, codes binary, cell int"


@dataclass
class PqIndex:
    """Stored vectors by cell, and what is needed to read them."""

    vectors: DataFrame        # id, vec, unit, codes, cell
    cells: DataFrame          # cell, n, reach: vectors and the least cosine to the centre
    centres: np.ndarray       # (cells, dim)
    books: np.ndarray         # (parts, CODES, dim / parts)


def unit_rows(vecs, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of the usable ones of a batch."""
    fit = [i for i, v in enumerate(vecs) if v is not None and len(v) == dim and np.any(v) and np.all(np.isfinite(v))]
    if not fit:
        return np.zeros(0, np.int64), np.zeros((0, dim))
    m = np.vstack([np.asarray(vecs.iloc[i], dtype=float) for i in fit])
    return np.array(fit), m / np.linalg.norm(m, axis=1, keepdims=True)


def fit_books(residuals: np.ndarray, parts: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Code words of each part by Lloyd's rounds over the sample's residuals."""
    rng, width = np.random.default_rng(seed), residuals.shape[1] // parts
    books = np.empty((parts, CODES, width))
    for part in range(parts):
        x = residuals[:, part * width:(part + 1) * width]
        words = x[rng.choice(len(x), CODES, replace=len(x) < CODES)]
        for _ in range(rounds):
            near = nearest_words(x, words)
            sums, n = np.zeros_like(words), np.bincount(near, minlength=CODES)
            np.add.at(sums, near, x)
            words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
        books[part] = words
    return books


def nearest_words(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words ** 2).sum(1)[None, :] - 2 * (x @ words.T), axis=1)


def encoded(residuals: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(rows, parts) bytes: the nearest code word of every part."""
    width = books.shape[2]
    return np.stack([nearest_words(residuals[:, p * width:(p + 1) * width], words)
                     for p, words in enumerate(books)], axis=1).astype(np.uint8)


def build_pq_index(df: DataFrame, vec_col: str, id_col: str, path: str, *, cells: int, parts: int,
                   sample: int = SAMPLE, seed: int = 7) -> PqIndex:
    """Index every vector of ``df`` under ``path``; centres and code words are fitted on about ``sample``."""
    spark = df.sparkSession
    usable = df.filter(norm(vec_col) > 0).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    # The index has the dimension that most vectors have.
    dims = usable.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"))
    if (most := dims.orderBy(F.desc("n"), "dim").first()) is None:
        raise ValueError("no vector that has a direction")
    dim = most["dim"]
    if dim % parts:
        raise ValueError(f"{dim} dimensions can't be cut into {parts} equal parts")
    usable = usable.where(F.size("vec") == dim)
    centres = fit_centres(usable, "vec", "id", cells, sample, seed)
    share = min(1.0, sample / max(usable.count(), 1))
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    _, some = unit_rows(usable.filter(draw < share).toPandas()["vec"], dim)      # about `sample` rows
    books = fit_books(some - centres[(some @ centres.T).argmax(1)], parts, seed=seed)
    shared = spark.sparkContext.broadcast((centres, books))                      # cells x dim, CODES x dim numbers

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, books = shared.value
        for batch in batches:
            at, unit = unit_rows(batch["vec"], dim)
            cell, least = np.full(len(batch), NO_CELL, np.int32), np.full(len(batch), np.nan)
            codes = np.full(len(batch), None, dtype=object)
            if len(at):
                cosine = unit @ centres.T
                own = cosine.argmax(1)
                cell[at], least[at] = own, cosine.max(1)
                codes[at] = [row.tobytes() for row in encoded(unit - centres[own], books)]
            yield pd.DataFrame({"id": batch["id"], "vec": batch["vec"], "unit": least, "codes": codes, "cell": cell})

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
    part = F.pmod(F.xxhash64("id"), F.lit(4))        # a full cell is spread over several files
    (rows.mapInPandas(placed, STORED).repartition("cell", part)
     .write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors"))
    stored = spark.read.schema(STORED).parquet(f"{path}/vectors")
    (stored.where(F.col("cell") != NO_CELL).groupBy("cell").agg(F.count("*").alias("n"), F.min("unit").alias("reach"))
     .write.mode("overwrite").parquet(f"{path}/cells"))
    fitted = [(k, c, [float(x) for x in v]) for k, table in (("centre", centres), ("word", books.reshape(-1, books.shape[2])))
              for c, v in enumerate(table)]
    spark.createDataFrame(fitted, "kind string, number int, value array<double>").write.mode("overwrite").parquet(f"{path}/fitted")
    return load_pq_index(spark, path)


def load_pq_index(spark: SparkSession, path: str) -> PqIndex:
    rows = spark.read.parquet(f"{path}/fitted").orderBy("kind", "number").collect()   # cells + parts x CODES rows
    centres = np.array([r["value"] for r in rows if r["kind"] == "centre"])
    words = np.array([r["value"] for r in rows if r["kind"] == "word"])
    return PqIndex(spark.read.schema(STORED).parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/cells"),
                   centres, words.reshape(-1, CODES, words.shape[1]))


def asked_cells(index: PqIndex, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, query, cell, order, near, first): all cells of each query by nearness, ``first`` for those read at once.

    ``near`` bounds the cosine of the query to anything in the cell.
    """
    rows = index.cells.collect()                      # one row per cell
    n = np.zeros(len(index.centres), np.int64)
    reach = np.ones(len(index.centres))
    for r in rows:
        n[r["cell"]], reach[r["cell"]] = r["n"], r["reach"]
    shared = queries.sparkSession.sparkContext.broadcast((index.centres, n, np.arccos(np.clip(reach, -1, 1))))

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, n, width = shared.value
        for batch in batches:
            at, unit = unit_rows(batch["query"], centres.shape[1])
            cosine = unit @ centres.T
            order = np.argsort(-cosine, axis=1, kind="stable")
            held = np.cumsum(n[order], axis=1) - n[order]
            first = (held < MARGIN * k) | (np.arange(len(n)) < probes)
            # The angle to a cell's vectors is at least that to its centre less the cell's width.
            near = np.cos(np.maximum(np.arccos(np.clip(np.take_along_axis(cosine, order, 1), -1, 1)) - width[order], 0))
            yield pd.DataFrame({
                "query_id": pd.Series(np.repeat(batch["query_id"].to_numpy(dtype=object)[at], len(n)), dtype=object), "cell": order.ravel().astype(np.int32),
                "near": near.ravel(), "first": first.ravel()})

    kind = queries.schema["query_id"].dataType.simpleString()
    found = queries.select("query_id", "query").mapInPandas(ranked, f"query_id {kind}, cell int, near double, first boolean")
    return found.join(queries.select("query_id", "query"), "query_id")


def rough(index: PqIndex, asks: DataFrame, keep: int) -> DataFrame:
    """(query_id, cell, id, rough) of the ``keep`` best by code of every (query, cell, part of the cell)."""
    kind = asks.schema["query_id"].dataType.simpleString()
    shared = asks.sparkSession.sparkContext.broadcast((index.centres, index.books))

    def best(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "cell": [], "id": [], "rough": []}
        if len(rows) and len(queries):
            centres, books = shared.value
            codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)
            ids, centre = rows["id"].to_numpy(), centres[key[0]]
            of, asked = unit_rows(queries["query"], centres.shape[1])
            for q, name in zip(asked, queries["query_id"].to_numpy(dtype=object)[of], strict=True):
                tables = np.einsum("pcw,pw->pc", books, q.reshape(len(books), -1))
                value = q @ centre + tables[np.arange(len(books)), codes].sum(1)
                top = np.lexsort((ids, -value))[:keep]
                out["query_id"] += [name] * len(top)
                out["cell"] += [key[0]] * len(top)
                out["id"] += ids[top].tolist()
                out["rough"] += value[top].tolist()
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in out.items()})

    left = index.vectors.where(F.col("cell") != NO_CELL).join(asks.select("cell").distinct(), "cell", "left_semi").select(
        "id", "codes", "cell", F.pmod(F.xxhash64("id"), F.lit(PARTS)).alias("part"))
    right = asks.select("query_id", "query", "cell", F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))
    return (left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part"))
            .applyInPandas(best, f"query_id {kind}, cell int, id long, rough double"))


def exact(index: PqIndex, queries: DataFrame, found: DataFrame, keep: int) -> DataFrame:
    """(query_id, id, score) of each query's ``keep`` best by code, scored by the vectors themselves."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rough"), F.asc("id"))
    some = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    pairs = some.select("query_id", "cell", "id").join(index.vectors.select("cell", "id", "vec"), ["cell", "id"])
    return pairs.join(queries.select("query_id", "query"), "query_id").select(
        "query_id", "id", cosine("vec", F.col("query")).alias("score"))


def pq_topk(index: PqIndex, queries: DataFrame, path: str, k: int = 10, probes: int = 1, rerank: int = 8) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest by cosine of every row (query_id, query) of ``queries``.

    ``path`` is a folder of the caller's for the two passes; in each, ``rerank`` * k vectors a query are read.
    """
    spark, keep = queries.sparkSession, rerank * k

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    asks = stored(asked_cells(index, queries, k, probes), "asks")
    found = stored(exact(index, queries, rough(index, asks.where("first"), keep), keep), "first")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    kth = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(
        "query_id", F.col("score").alias("kth"))
    rest = stored(asks.where("NOT first").join(kth, "query_id", "left").where(
        F.col("kth").isNull() | (F.col("near") >= F.col("kth"))).drop("kth"), "rest")
    both = found.unionByName(stored(exact(index, queries, rough(index, rest, keep), keep), "second"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score")


def share_read(index: PqIndex, path: str) -> dict[str, float]:
    """Of all (query, vector) pairs, the shares whose codes were looked up, and whose vectors were read."""
    spark = index.cells.sparkSession
    asks = spark.read.parquet(f"{path}/asks").join(index.cells, "cell")
    rest = spark.read.parquet(f"{path}/rest").join(index.cells, "cell").agg(F.sum("n")).first()[0] or 0
    every, first = asks.agg(F.sum("n"), F.sum(F.when(F.col("first"), F.col("n")))).first()
    vectors = sum(spark.read.parquet(f"{path}/{name}").count() for name in ("first", "second"))
    return {"codes": ((first or 0) + rest) / every, "vectors": vectors / every}
