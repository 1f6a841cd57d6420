"""V6: recall of the stored index on the given vectors, and its bounds and edge cases."""

import numpy as np
import pytest

from almanac.operators import ann
from almanac.session import scratch_path

from .conftest import SF_CHECK


def brute_topk(ids, vectors, queries, k):
    """query id -> the ids of its k nearest by cosine, ties by id."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for name, q in queries:
        score = unit @ (q / np.linalg.norm(q))
        out[name] = [int(ids[i]) for i in np.lexsort((ids, -np.round(score, 12)))[:k]]
    return out


def recall(got, want):
    return np.mean([len(set(got.get(q, [])) & set(ids)) / len(ids) for q, ids in want.items()])


def found_by(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("sf", [SF_CHECK, "/root/testdata/sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    """All queries with an id divisible by 50 against all vectors: recall@10 of at least 0.9."""
    emb = spark.read.parquet(f"{sf}/embeddings.parquet")
    path = scratch_path(spark, "ann-recall")
    index = ann.build_pq_index(emb, "embedding", "vec_id", path, cells=16, parts=32)
    assert index.vectors.count() == emb.count()
    asked = emb.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    got = found_by(ann.pq_topk(index, asked, f"{path}/search", k=10))
    rows = emb.select("vec_id", "embedding").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute_topk(ids, vectors, [(r.vec_id, np.array(r.embedding, float)) for r in rows if r.vec_id % 50 == 0], 10)
    assert len(want) == emb.where("vec_id % 50 = 0").count()
    share = ann.share_read(index, f"{path}/search")
    print(sf, "recall", recall(got, want), "share read", share)
    assert recall(got, want) >= 0.9 and share["vectors"] < 0.5


def test_cells_that_cannot_matter_are_left_out(spark):
    """Well separated vectors: the bound by angle stops after the first cells, and nothing is lost."""
    rng = np.random.default_rng(1)
    heads = rng.normal(size=(20, 16))
    rows = [(i, [float(x) for x in heads[i % 20] + 0.05 * rng.normal(size=16)]) for i in range(2000)]
    path = scratch_path(spark, "ann-apart")
    df = spark.createDataFrame(rows, "vec_id long, v array<float>").repartition(4)
    index = ann.build_pq_index(df, "v", "vec_id", path, cells=20, parts=8)
    asked = df.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "v AS query")
    got = found_by(ann.pq_topk(index, asked, f"{path}/search", k=10))
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    want = brute_topk(ids, vectors, [(i, np.array(v)) for i, v in rows if i % 50 == 0], 10)
    share = ann.share_read(index, f"{path}/search")
    print("recall", recall(got, want), "share read", share)
    assert recall(got, want) >= 0.95 and share["codes"] < 0.4 and share["vectors"] < 0.1


def test_unusable_vectors_and_few_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.0])]
    path = scratch_path(spark, "ann-odd")
    index = ann.build_pq_index(spark.createDataFrame(rows, "id long, v array<float>"), "v", "id", path, cells=2, parts=1)
    asked = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [0.0, 0.0]), ("c", None)], "query_id string, query array<float>")
    got = found_by(ann.pq_topk(index, asked, f"{path}/search", k=2))
    assert got == {"a": [1, 6]} and index.vectors.count() == 6
    none = asked.where("query_id = 'z'")
    assert ann.pq_topk(index, none, f"{path}/none", k=2).count() == 0
