"""Covers of query words, and the default reranker."""

import random

from pyspark.sql import functions as F

from tessera.operators import reranking


def test_least_cover_against_all_runs():
    rng = random.Random(7)
    for _ in range(400):
        words = rng.choices("abcdefg", k=rng.randint(0, 14))
        asked = set(rng.sample("abcxy", k=rng.randint(0, 4)))
        there = asked & set(words)
        runs = [j - i for i in range(len(words)) for j in range(i + 1, len(words) + 1) if there and there <= set(words[i:j])]
        assert reranking.least_cover(words, asked) == (len(there), min(runs, default=0))


def test_scores(spark):
    rows = [(1, "red apple pie", "apple pie", [1.0, 0.0], [1.0, 0.0]), (2, "apple of some other pie", "apple pie", [0.0, 1.0], [1.0, 0.0]), (3, "nothing", "apple pie", None, [1.0, 0.0]), (4, None, "", None, None), (5, "apple", "apple pie", [0.0, 0.0], [1.0, 0.0])]
    hits = spark.createDataFrame(rows, "k int, content string, text string, vec array<double>, qvec array<double>")
    got = {r.k: round((r.s + 0.5) / 1.5, 4) for r in hits.withColumn("s", reranking.cover_score(hits)).collect()}
    assert got == {1: 1.0, 2: 0.6, 3: 0.0, 4: 0.0, 5: 0.45}
    bare = hits.drop("vec").filter("k = 1")
    assert bare.select(reranking.cover_score(bare).alias("s")).first().s == 1.0
    assert hits.limit(0).withColumn("s", reranking.cover_score(hits)).select(F.col("s")).count() == 0
