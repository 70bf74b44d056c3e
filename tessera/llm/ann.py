"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Each block of rows keeps, for every one of ``PROJECTIONS`` random directions, its rows sorted by projection. A query
looks at windows around its own projections, half as wide as ``HALF_WIDTH`` times a radius; a row collides where it
lies in the window. Virtual rehashing widens the windows as the radius grows, adding only the two new strips to the
counts. Rows whose count reaches the threshold are verified by their true distance. The radius grows by ``GROWTH``, so
that it doesn't pass far beyond the k-th row, where in many dimensions most rows lie, and stops at
the distance of the k-th best row verified so far: a row at the radius reaches the threshold with probability
``CATCH``, nearer ones more often. Later blocks of a task start at the radius already reached.

Every row is indexed. The queries are broadcast in chunks of at most ``CHUNK_BYTES``, one pass over the rows for each
chunk; a task gives its k best for each query, and the k best of those are kept.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null id.
Rows with the query's id are the query's own. Vectors of another dimension than the query's aren't candidates. Among
rows of one id that are queries, the least vector is the query. Repeated rows are candidates each; ties go to the
smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import pick, session_of, ship

PROJECTIONS, HALF_WIDTH, CATCH, GROWTH = 128, 1.1, 0.9, 1.15
BLOCK, CHUNK_BYTES, FIRST_RADIUS = 8192, 16 << 20, 0.05
SLACK = 1e-5


def threshold(m: int, half: float, catch: float) -> int:
    """Collisions that a row at the radius reaches with probability ``catch`` at least."""
    p = 2 * NormalDist().cdf(half) - 1
    return max(1, int(m * p + NormalDist().inv_cdf(1 - catch) * (m * p * (1 - p)) ** 0.5))


class Index:
    """Sorted projections of a block of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, directions: np.ndarray):
        self.ids, self.vectors = ids, vectors
        projected = (vectors @ directions).T
        self.order = np.argsort(projected, axis=1).astype(np.int32)
        self.sorted = np.take_along_axis(projected, self.order, axis=1)

    def windows(self, at: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window ends in each sorted array: (directions, queries)."""
        low = np.empty(at.shape, np.int64)
        high = np.empty(at.shape, np.int64)
        for j, row in enumerate(self.sorted):
            low[j] = np.searchsorted(row, at[j] - half, side="left")
            high[j] = np.searchsorted(row, at[j] + half, side="right")
        return low, high


class Search:
    """The queries of a task, with the best rows found so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, seed: int = 11, m: int = PROJECTIONS, half: float = HALF_WIDTH, catch: float = CATCH):
        self.ids, self.vectors, self.k, self.half = ids, vectors.astype(np.float64), k, half
        self.directions = np.random.default_rng(seed).normal(0, 1, (vectors.shape[1], m))
        self.at = (self.vectors @ self.directions).T
        self.need = threshold(m, half, catch)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        self.verified = 0

    def radius(self, q: int) -> float:
        far = self.best[q][0]
        return float(far[-1]) if len(far) == self.k else np.inf

    def verify(self, q: int, index: Index, rows: np.ndarray) -> None:
        rows = rows[index.ids[rows] != self.ids[q]]
        if not len(rows):
            return
        self.verified += len(rows)
        far = np.sqrt(np.square(index.vectors[rows] - self.vectors[q]).sum(1))
        far, ids = np.concatenate([self.best[q][0], far]), np.concatenate([self.best[q][1], index.ids[rows]])
        keep = np.lexsort((ids, far))[: self.k]
        self.best[q] = far[keep], ids[keep]

    def add(self, index: Index) -> None:
        n, m = len(index.ids), len(self.at)
        known = np.array([self.radius(q) for q in range(len(self.ids))])
        radius = np.where(np.isfinite(known), known, FIRST_RADIUS)
        counts: dict[int, np.ndarray] = {}
        done: dict[int, np.ndarray] = {}
        before: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        open_ = np.arange(len(self.ids))
        while len(open_):
            low, high = index.windows(self.at[:, open_], self.half * radius[open_] + SLACK)
            still = []
            for c, q in enumerate(open_.tolist()):
                a, b = low[:, c].tolist(), high[:, c].tolist()
                if q in before:
                    a0, b0 = before[q]
                    strips = [index.order[j, x:y] for j in range(m) for x, y in ((a[j], a0[j]), (b0[j], b[j])) if y > x]
                else:
                    strips = [index.order[j, x:y] for j, (x, y) in enumerate(zip(a, b)) if y > x]
                fresh = np.bincount(np.concatenate(strips), minlength=n) if strips else np.zeros(n, np.int64)
                count = counts[q] + fresh if q in counts else fresh
                hit = count >= self.need
                self.verify(q, index, np.flatnonzero(hit & ~done[q] if q in done else hit))
                if radius[q] >= self.radius(q) or all(x == 0 and y == n for x, y in zip(a, b)):
                    for kept in (counts, done, before):
                        kept.pop(q, None)
                    continue
                counts[q], done[q], before[q] = count, hit, (a, b)
                radius[q] = min(GROWTH * radius[q], max(self.radius(q), FIRST_RADIUS))
                still.append(q)
            open_ = np.array(still, int)


def takes_part(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & whole & F.exists(vector, lambda x: x != 0)


def _run(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {dim: Search(ids, vectors, k) for dim, (ids, vectors) in queries.value.items()}
        held: dict[int, list] = {dim: [] for dim in searches}

        def work(dim: int) -> None:
            if held[dim]:
                ids, vectors = (np.concatenate(x) for x in zip(*held[dim]))
                held[dim] = []
                for i in range(0, len(ids), BLOCK):
                    searches[dim].add(Index(ids[i : i + BLOCK], vectors[i : i + BLOCK], searches[dim].directions))

        for batch in batches:
            ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begins = np.cumsum(sizes) - sizes
            for dim in searches:
                rows = np.flatnonzero(sizes == dim)
                if len(rows):
                    held[dim].append((ids[rows], flat[begins[rows][:, None] + np.arange(dim)]))
                    if sum(len(x[0]) for x in held[dim]) >= BLOCK:
                        work(dim)
        for dim, search in searches.items():
            work(dim)
            for i in range(0, len(search.ids), 4000):
                part = range(i, min(i + 4000, len(search.ids)))
                far = [search.best[q] for q in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(search.ids[part.start : part.stop], [len(x[0]) for x in far]), pa.int64()),
                        pa.array(np.concatenate([x[1] for x in far]), pa.int64()),
                        pa.array(np.concatenate([x[0] for x in far]), pa.float64()),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def chunks(queries: DataFrame, most_bytes: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The queries by dimension, in parts of bounded size; one part at a time is on the driver."""
    held, size = {}, 0
    for row in queries.toLocalIterator():
        if held and size + 8 * len(row[1]) > most_bytes:
            yield {d: (np.array([r[0] for r in x], np.int64), np.array([r[1] for r in x])) for d, x in held.items()}
            held, size = {}, 0
        held.setdefault(len(row[1]), []).append(row)
        size += 8 * len(row[1])
    if held:
        yield {d: (np.array([r[0] for r in x], np.int64), np.array([r[1] for r in x])) for d, x in held.items()}


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest rows found for each query."""
    spark = session_of(vectors)
    ship(spark)
    rows = pick(vectors, key, vector).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & takes_part(F.col("embedding")))
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("embedding"))
    found = None
    for part in chunks(queries, chunk_bytes):
        shared = spark.sparkContext.broadcast(part)
        own = rows.mapInArrow(_run(shared, k), "query_id bigint, vec_id bigint, score double")
        found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
