"""Indexes of retrieval: binary codes and postings in blocks."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.cluster import Workspace
from tessera.operators import blockmax, bm25, quantised

DATA = "/root/testdata"


def cosine_top(q, own, ids, vectors, k):
    s = np.round(vectors @ own / (np.linalg.norm(vectors, axis=1) * np.linalg.norm(own)), 6)
    return {int(ids[i]) for i in np.lexsort((ids, -s))[:k]}


@pytest.mark.parametrize("size", [s for s in ("sf0.001", "sf0.01", "sf0.1", "check_s") if os.path.exists(f"{DATA}/{s}/embeddings.parquet")])
def test_codes_find_the_nearest(spark, size):
    chunks = spark.read.parquet(f"{DATA}/{size}/embeddings.parquet").select(F.col("vec_id").alias("doc"), F.col("embedding").cast("array<double>").alias("vec")).filter("vec is not null")
    rows = chunks.collect()
    ids, vectors = np.array([r.doc for r in rows]), np.array([r.vec for r in rows])
    queries = chunks.orderBy(F.xxhash64("doc")).limit(60).select(F.col("doc").alias("query"), F.col("vec").alias("qvec"))
    work = Workspace(spark)
    index = quantised.Codes(chunks, work.keep)
    got: dict = {}
    for r in index.search(queries, 10).collect():
        got.setdefault(r.query, set()).add(r.doc)
    hits = [len(got[q.query] & cosine_top(q.query, np.array(q.qvec), ids, vectors, 10)) / 10 for q in queries.collect()]
    assert np.mean(hits) >= 0.9
    assert index.candidates(queries, 40).count() == 60 * 40 < 0.1 * 60 * len(rows)
    work.close()


def test_codes_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [-1.0, 0.0]), (4, None), (5, []), (6, [1.0, 2.0, 3.0]), (7, [None, 1.0]), (8, [1.0, 0.0])]
    chunks = spark.createDataFrame(rows, "doc long, vec array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 2.0, 3.0]), (2, [])], "query long, qvec array<double>")
    index = quantised.Codes(chunks, Workspace(spark).keep)
    got = sorted((r.query, r["rank"], r.doc) for r in index.search(queries, 2).collect())
    assert got == [(0, 1, 1), (0, 2, 8), (1, 1, 6)]
    assert sorted((r.query, r.doc) for r in index.search(queries, 2, allowed=chunks.filter("doc > 2"), most_queries=1).collect()) == [(0, 3), (0, 8), (1, 6)]
    assert index.search(queries.limit(0), 2).count() == 0
    codes = quantised.packed_signs(np.array([[1.0, -1.0] + [0.0] * 62, [-1.0] * 63 + [1.0]]), 64)
    assert codes.tolist() == [[1], [-(1 << 63)]]


def test_blocks_equal_all_postings(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(words[: rng.choice([5, 300])]) for _ in range(rng.choice([3, 20, 200])))) for i in range(900)] + [(900 + i, "w1 w2 w3") for i in range(30)]
    model = bm25.Model().fit(spark.createDataFrame(docs, "doc long, text string").repartition(3), "doc", "text")
    queries = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w250 w299 w3"), (3, "w7"), (4, "unknown"), (5, " ".join(words[:40])), (6, "w1 w1 W200")], "q long, t string")
    asked = model.asked(queries, "q", "t")
    want = sorted(map(tuple, bm25.top(model.scores(queries, "q", "t"), 10).select("query", "doc", "score", "rank").collect()))
    work = Workspace(spark)
    index = blockmax.Index.build(model.postings, work.keep, per_block=8)
    found = lambda **o: sorted(map(tuple, index.search(asked, 10, **o).select("query", "doc", "score", "rank").collect()))
    assert found() == want
    assert found(first=1) == want
    few = spark.createDataFrame([(i,) for i in range(0, 930, 7)], "doc long")
    inside = bm25.top(model.scores(queries, "q", "t").join(few, "doc"), 10)
    assert found(allowed=few) == sorted(map(tuple, inside.select("query", "doc", "score", "rank").collect()))
    read, all_ = index.read(asked.filter("query < 4"), 10)
    assert read < 0.5 * all_
    work.close()


def test_blocks_with_salted_tokens(spark, monkeypatch):
    monkeypatch.setattr(blockmax, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(blockmax, "SALT_ROWS", 2)
    docs = spark.createDataFrame([(i, "hot cold" if i % 9 else "hot rare cold cold") for i in range(200)], "doc long, text string")
    model = bm25.Model().fit(docs, "doc", "text")
    queries = spark.createDataFrame([(1, "hot rare"), (2, "cold")], "q long, t string")
    index = blockmax.Index.build(model.postings, Workspace(spark).keep, per_block=4)
    want = bm25.top(model.scores(queries, "q", "t"), 5)
    assert sorted(map(tuple, index.search(model.asked(queries, "q", "t"), 5).collect())) == sorted(map(tuple, want.select("query", "doc", "score", "rank").collect()))


def test_share_of_postings_on_documents(spark, sf):
    docs, asked = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    model = bm25.Model().fit(docs, "doc_id", "text")
    index = blockmax.Index.build(model.postings, Workspace(spark).keep)
    read, all_ = index.read(model.asked(asked, "item_id", "text"), 10)
    assert read < 0.7 * all_
