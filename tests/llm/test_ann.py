import numpy as np
from pyspark.sql import functions as F

from tessera.llm import ann as A


def exact(ids, vectors, q, k):
    far = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
    far[ids == ids[q]] = np.inf
    keep = np.lexsort((ids, far))[:k]
    return [(int(ids[i]), float(far[i])) for i in keep if np.isfinite(far[i])]


def test_recall_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in A.nearest(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 20 == 0, chunk_bytes=2000).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        want, found = exact(ids, vectors, q, 10), got[ids[q]]
        assert sorted(found) == list(range(1, len(found) + 1))
        by_id = dict(found.values())
        hits.append(sum(i in by_id and abs(by_id[i] - d) < 1e-9 for i, d in want) / len(want))
    assert np.mean(hits) >= 0.9


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0]), (None, [1.0, 0.0]), (100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "vec_id AS rank", "vec_id AS score")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in A.nearest(df, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, round(2**0.5, 6))]
    assert A.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_ties_at_the_last_rank(spark):
    rng = np.random.default_rng(4)
    query, near, far = rng.normal(size=8), rng.normal(size=8), rng.normal(size=8) * 9
    rows = [(0, query.tolist())] + [(i, (query + 0.1 * near).tolist()) for i in range(40, 10, -1)] + [(i, (query + far).tolist()) for i in range(41, 300) if i % 100]
    got = A.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(i + 1, 11 + i) for i in range(10)]


def share_and_recall(x, ids, k=10):
    """Verified of all pairs of queries and rows, and recall."""
    q = np.flatnonzero(ids % 100 == 0)
    search = A.Search(ids[q], x[q], k)
    for i in range(0, len(ids), A.BLOCK):
        search.add(A.Index(ids[i : i + A.BLOCK], x[i : i + A.BLOCK], search.directions))
    hits = [len({i for i, _ in exact(ids, x, n, k)} & set(search.best[j][1].tolist())) / k for j, n in enumerate(q)]
    return search.verified / (len(q) * len(ids)), np.mean(hits)


def test_counting_leaves_rows_out(spark, sf):
    rng = np.random.default_rng(0)
    clustered = np.repeat(rng.normal(size=(200, 64)), 20, 0) + 0.1 * rng.normal(size=(4000, 64))
    share, recall = share_and_recall(clustered, np.arange(4000))
    print("clustered", share, recall)
    assert share < 0.1 and recall >= 0.9
    rows = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/embeddings.parquet").filter("embedding is not null").collect()
    share, recall = share_and_recall(np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows]))
    print("even", share, recall)
    assert share < 0.5 and recall >= 0.9
