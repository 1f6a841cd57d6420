"""Vector search: encode (V1), exact cosine top-k (V2, L4, L6, R7), many
queries at once, and approximate neighbours by cells (V6).

Exact search is one pass over the vectors with a JVM-side expression and a
TakeOrderedAndProject (each task keeps its own top k; the driver merges
``k x tasks`` rows). The query vector is a literal and its norm a number computed
once on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.computed import with_computed
from ..functions.vectors import as_vector, cosine, dot, norm
from .season import relevance_band

# The dashboard's search settings.
TOP_K, THRESHOLD, SHOWN = 10, 0.40, 5
ENCODE_BATCH = 32


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def query_vector(df: DataFrame, id_col: str, id_value, vec_col: str = "embedding") -> list[float]:
    """Fetch one stored vector to use as a query (a single row)."""
    row = df.filter(F.col(id_col) == id_value).select(vec_col).first()
    if row is None:
        raise KeyError(f"no vector with {id_col} = {id_value!r}")
    return [float(x) for x in row[0]]


def with_cosine(df: DataFrame, vec_col: str, query, name: str = "score") -> DataFrame:
    """Add the cosine to ``query``, computed once per row even when later
    filters test it."""
    return with_computed(df, **{name: cosine(vec_col, query)})


def cosine_topk(df: DataFrame, vec_col: str, query, k: int = TOP_K, id_col: str = "id",
                name: str = "score") -> DataFrame:
    """L4: the k most similar rows; NULL scores (zero vectors) sort last."""
    return (with_cosine(df, vec_col, query, name)
            .orderBy(F.desc_nulls_last(name), F.asc(id_col)).limit(k))


def banded_search(df: DataFrame, vec_col: str, query, id_col: str = "id", k: int = TOP_K,
                  threshold: float = THRESHOLD, shown: int = SHOWN) -> DataFrame:
    """L6 + P12 + R7: top k, then the threshold, then the first ``shown``,
    each with its relevance band (threshold applied after the limit, T13)."""
    top = cosine_topk(df, vec_col, query, k, id_col)
    kept = top.filter(F.col("score") >= threshold)
    return (kept.orderBy(F.desc("score"), F.asc(id_col)).limit(shown)
            .withColumn("band", relevance_band("score")))


def centroids(df: DataFrame, vec_col: str, by: str) -> DataFrame:
    """Mean vector per group: one JVM aggregate (``Summarizer.mean``) with
    partial aggregation, returned as ``array<double>``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    vecs = df.select(by, array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v"))
    return (vecs.groupBy(by).agg(Summarizer.mean(F.col("_v")).alias("_m"))
            .select(by, vector_to_array("_m").alias("centroid")))


def multi_query_topk(df: DataFrame, vec_col: str, queries: DataFrame, k: int,
                     id_col: str = "id", block: int = 1024) -> DataFrame:
    """Exact top k for each row (query_id, query) of ``queries``: (query_id, rank, id, score).

    Any number of queries: they are taken ``block`` at a time, and each block is one
    pass over the vectors, a matrix product per Arrow batch in which a task keeps k
    rows per query. Only those meet in the final ranking. NULL scores (zero vectors,
    other lengths) sort last, ties by id."""
    out = None
    rows = queries.orderBy("query_id").toLocalIterator()
    while part := list(islice(rows, block)):
        top = _block_topk(df, vec_col, part, k, id_col, queries.schema["query_id"].dataType)
        out = top if out is None else out.unionByName(top)
    if out is None:
        return queries.join(df.limit(0), F.lit(False)).select(
            "query_id", F.lit(0).alias("rank"), id_col, F.lit(0.0).alias("score"))
    return out


def _block_topk(df: DataFrame, vec_col: str, queries: Sequence, k: int, id_col: str,
                query_type: T.DataType) -> DataFrame:
    ids, vectors = [q["query_id"] for q in queries], [list(q["query"]) for q in queries]
    sizes = {len(v) for v in vectors}
    shared = df.sparkSession.sparkContext.broadcast({
        n: ([i for i, v in enumerate(vectors) if len(v) == n],
            np.array([v for v in vectors if len(v) == n], dtype=float)) for n in sizes})

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = np.full((len(ids), 0), -np.inf)
        found = np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            new = np.full((len(ids), len(batch)), -np.inf)       # -inf stands for NULL
            length = np.array([-1 if v is None else len(v) for v in batch["vec"]])
            for n, (at, q) in shared.value.items():
                have = np.flatnonzero(length == n)
                if not len(have):
                    continue
                m = np.vstack([np.asarray(v, dtype=float) for v in batch["vec"].iloc[have]])
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = (q @ m.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(m, axis=1))
                new[np.ix_(at, have)] = np.where(np.isfinite(s), s, -np.inf)
            both = np.concatenate([score, new], axis=1)
            names = np.concatenate([found, np.broadcast_to(batch["id"].to_numpy(), new.shape)], axis=1)
            keep = np.array([np.lexsort((names[i], -both[i]))[:k] for i in range(len(ids))])
            score, found = np.take_along_axis(both, keep, 1), np.take_along_axis(names, keep, 1)
        number = np.repeat(np.arange(len(ids)), score.shape[1])
        flat = score.ravel()
        yield pd.DataFrame({"query_no": number, "id": found.ravel(),
                            "score": pd.Series(np.where(np.isinf(flat), np.nan, flat))})

    heads = (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
             .mapInPandas(best, "query_no long, id long, score double")
             .withColumn("score", F.when(~F.isnan("score"), F.col("score"))))
    w = Window.partitionBy("query_no").orderBy(F.desc_nulls_last("score"), F.asc("id"))
    top = heads.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    names = df.sparkSession.createDataFrame(
        list(enumerate(ids)), T.StructType([T.StructField("query_no", T.LongType()),
                                            T.StructField("query_id", query_type)]))
    return top.join(F.broadcast(names), "query_no").select(      # at most `block` rows
        "query_id", "rank", F.col("id").alias(id_col), "score")


# --- V1: encoders ----------------------------------------------------------------

def hashed_encoder_vectors(df: DataFrame, text_col: str, dim: int = 64,
                           out_col: str = "embedding") -> DataFrame:
    """Built-in encoder: hashed token counts, L2-normalised, all in the JVM
    (``HashingTF`` + ``Normalizer``), returned as ``array<double>``."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    from ..functions.text import tokens
    staged = df.withColumn("_tok", tokens(text_col))
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim).transform(staged)
    normed = Normalizer(inputCol="_tf", outputCol="_nv", p=2.0).transform(tf)
    return normed.withColumn(out_col, vector_to_array("_nv")).drop("_tok", "_tf", "_nv")


def encode(df: DataFrame, text_col: str, encoder_factory: Callable | None = None,
           dim: int = 64, out_col: str = "embedding",
           batch_size: int = ENCODE_BATCH) -> DataFrame:
    """V1: add a vector column for ``text_col``.

    ``encoder_factory()`` must return a callable ``list[str] -> array (n, dim)``;
    it is called once per task (model loading), then fed Arrow batches cut
    into ``batch_size`` texts. Without a factory the JVM hashed encoder runs.
    """
    if encoder_factory is None:
        return hashed_encoder_vectors(df, text_col, dim, out_col)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder_factory()
        for texts in batches:
            values = texts.fillna("").tolist()
            out = []
            for i in range(0, len(values), batch_size):
                out.extend(np.asarray(model(values[i:i + batch_size]), dtype=np.float32))
            yield pd.Series([list(map(float, v)) for v in out], dtype=object)

    return df.withColumn(out_col, _encode(F.col(text_col)))


def letter_encoder():
    """A caller's encoder of the simplest kind: counts of the letters a to z."""
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    return lambda texts: np.array([[t.count(x) for x in letters] for t in texts], dtype=np.float32)


def encode_query(spark, text: str, encoder_factory: Callable | None = None, dim: int = 64) -> list[float]:
    """The vector of a query text, by the encoder that made the stored ones (one row)."""
    one = encode(spark.createDataFrame([(text,)], "text string"), "text", encoder_factory, dim)
    return [float(x) for x in one.first()["embedding"]]


# --- V6: approximate neighbours -------------------------------------------------
#
# Vectors are stored once, partitioned by the cell of their nearest centre. Centres
# come from spherical k-means on a bounded sample; every vector is stored. A query
# ranks the centres, reads the cells of the nearest ones (partition pruning) and ranks
# what it finds there by exact cosine. How many cells there are and how many are read
# is the caller's choice; neither follows the size of the table.

NO_CELL = -1        # zero and missing vectors: no cosine, never read by a query


@dataclass
class AnnIndex:
    vectors: DataFrame       # id, vec, cell
    centres: np.ndarray      # (cells, dim)


def fit_centres(df: DataFrame, vec_col: str, id_col: str, cells: int, sample: int = 50_000,
                seed: int = 7) -> np.ndarray:
    """Centres of ``cells`` cells, fitted on about ``sample`` vectors chosen by a hash of the id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    usable = df.filter(norm(vec_col) > 0).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    share = min(1.0, sample / max(usable.count(), 1))
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    picked = usable.filter(draw < share).select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(picked)
    found = np.array([np.asarray(c) for c in model.clusterCenters()])
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def build_ann_index(df: DataFrame, vec_col: str, id_col: str, cells: int,
                    sample: int = 50_000, seed: int = 7) -> AnnIndex:
    """V6 index: every row of ``df`` with the cell of its nearest centre."""
    centres = fit_centres(df, vec_col, id_col, cells, sample, seed)
    shared = df.sparkSession.sparkContext.broadcast(centres)      # cells x dim numbers

    @F.pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vecs in batches:
            out = np.full(len(vecs), NO_CELL, np.int32)
            fit = [i for i, v in enumerate(vecs) if v is not None and len(v) == shared.value.shape[1] and np.any(v)]
            if fit:
                m = np.vstack([np.asarray(vecs.iloc[i], dtype=float) for i in fit])
                out[fit] = (m @ shared.value.T).argmax(1)
            yield pd.Series(out)

    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    return AnnIndex(rows.withColumn("cell", nearest("vec")), centres)


def save_ann_index(index: AnnIndex, path: str, files_per_cell: int = 4) -> None:
    """Write the vectors once, a folder per cell; a full cell is spread over several files."""
    spark = index.vectors.sparkSession
    part = F.pmod(F.xxhash64("id"), F.lit(files_per_cell))
    (index.vectors.repartition("cell", part).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors"))
    rows = [(c, [float(x) for x in v]) for c, v in enumerate(index.centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")


def load_ann_index(spark, path: str) -> AnnIndex:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()      # `cells` rows
    return AnnIndex(spark.read.parquet(f"{path}/vectors"), np.array([r["centre"] for r in rows]))


def probed(index: AnnIndex, query: Sequence[float], probes: int) -> DataFrame:
    """The vectors that a query with ``probes`` cells reads."""
    order = np.argsort(-(index.centres @ np.asarray(query, dtype=float)), kind="stable")
    return index.vectors.filter(F.col("cell").isin([int(c) for c in order[:probes]]))


def approx_topk(index: AnnIndex, query: Sequence[float], k: int = TOP_K, probes: int = 8,
                id_col: str = "id") -> DataFrame:
    """V6: the k nearest by cosine among the vectors of the ``probes`` nearest cells."""
    rows = probed(index, query, probes).select(F.col("id").alias(id_col), "vec")
    return cosine_topk(rows, "vec", query, k, id_col).select(id_col, "score")


__all__ = ["approx_topk", "banded_search", "centroids", "cosine_topk", "dot", "encode",
           "multi_query_topk", "norm", "query_vector", "with_cosine"]
