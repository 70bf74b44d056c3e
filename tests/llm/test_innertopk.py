import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import innertopk as P


def exact(rows, is_query, k, scale=64):
    whole = [(i, tuple(int(np.floor(scale * x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for (i, v), raw in zip(whole, [v for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]):
        if is_query(i) and (i not in queries or list(raw) < queries[i][0]):
            queries[i] = (list(raw), v)
    out = []
    for q, (_, v) in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, u)), i) for i, u in whole if i != q and len(u) == len(v))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def found(spark, rows, every, k=20, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id AS rank", "vec_id AS score", "vec_id AS `VEC_ID_`").repartition(3)
    return sorted(tuple(r) for r in P.best_products(df, F.col("vec_id") % every == 0, k, **options).collect())


@pytest.mark.parametrize("kind", ["normal", "unit", "low rank", "ties", "lengths"])
def test_against_brute_force(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 24))
    if kind == "unit":
        x /= np.sqrt((x**2).sum(1))[:, None]
    if kind == "low rank":
        x = x[:, :3] @ rng.normal(size=(3, 24)) + 0.01 * x
    if kind == "ties":
        x = np.repeat(np.round(x[:30]), 20, 0)
    if kind == "lengths":
        x *= np.exp(rng.normal(size=(600, 1)) * 2)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    monkeypatch.setattr(P, "BLOCK", 100)
    assert found(spark, rows, 20, seeds=50, sample=40, chunk_bytes=2000) == exact(rows, lambda i: i % 20 == 0, 20)


def test_bounds_leave_pairs_out():
    rng = np.random.default_rng(6)
    x = np.floor(64 * (rng.normal(size=(4000, 4)) @ rng.normal(size=(4, 32)) + 0.05 * rng.normal(size=(4000, 32))))
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    search = P.Search(np.arange(0, 4000, 20), x[::20], np.full(200, -np.inf), 20, turn)
    for i in range(0, 4000, 500):
        search.add(np.arange(i, i + 500), x[i : i + 500])
    assert search.scored < 0.15 * search.met
    want = np.sort(x[::20] @ x.T - 1e18 * (np.arange(0, 4000, 20)[:, None] == np.arange(4000)), axis=1)[:, ::-1][:, :20]
    assert (search.score.reshape(200, 20) == want).all()


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.01]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (100, []), (200, []), (20, [0.0, 0.0]), (20, [-1.0, 5.0])]
    got = found(spark, rows, 20)
    assert got == exact(rows, lambda i: i % 20 == 0, 20)
    assert (100, 1, 200, 0) in got and (0, 1, 1, 4096) in got and (0, 2, 1, 4096) in got
    assert found(spark, [], 20) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**24 + 1, 3.0]), (1, [2.0**24 - 1, 1 / 64]), (2, [2.0**24 - 1, 2 / 64]), (3, [-(2.0**24), 0.0])]
    assert found(spark, rows, 20) == exact(rows, lambda i: i % 20 == 0, 20)
