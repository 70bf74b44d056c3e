"""Exact top-k search by inner product: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz residual bounds.

Components are turned into integers, floor(scale * x), and scores are their integer inner products, exact. A search goes

1. ``rotation``: the right singular vectors of a bounded sample of the vectors (``SAMPLE`` rows in hash order). A rotation
   changes no inner product; it only moves most of a vector's length into its first components, so the sample decides
   about speed and not about results.
2. ``seeded``: every query meets the ``SEEDS`` longest vectors and takes the k-th best score there as its first threshold.
3. ``Search``: each task reads its rows by descending length, in blocks. A block's rows that are too short for a query
   (length times length below its threshold) are left out; of the others the first rotated components are multiplied, and a
   row stays only while its partial sum, plus the product of the lengths of what is left of both vectors, reaches the
   threshold; further components follow until few rows stay. These are scored exactly, and the thresholds rise to the k-th
   best score that the task has found.
4. The best of all tasks are ranked.

Queries are broadcast in chunks of ``CHUNK_BYTES``, one pass over the rows for each; rows are neither shuffled nor collected.

Vectors that are null or hold null or non-finite components take no part; nor do rows with a null id. Zero and empty
vectors do. Candidates are rows with another id than the query's and with as many components. Among rows of one id that
are queries, the least vector is the query. Repeated rows are candidates each; ties go to the smaller id. A score beyond
64 bits is an error. Other columns, whatever their names, don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.ann import chunks
from tessera.llm.common import pick, session_of, ship

SCALE, SAMPLE, SEEDS, CHUNK_BYTES = 64, 4096, 4096, 16 << 20
BLOCK, ROWS, TILE, PAIRS = 8192, 2048, 128, 1 << 18
#: Partial sums take in these shares of the components, one after the other, while more than FEW of a tile's pairs stay.
HEADS, FEW = (0.125, 0.25, 0.5, 0.75), 0.02
EXACT, HUGE = float(1 << 53), 1e60
SCHEMA = "query_id bigint, vec_id bigint, score bigint"


def lengths_from(x: np.ndarray, at: list[int]) -> np.ndarray:
    """Lengths of what is left of each vector from the given components on: (vectors, places)."""
    return np.stack([np.sqrt(np.square(x[:, a:]).sum(1)) for a in at], 1)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, row by row. As floats while no sum can pass 2^53, else as Python's integers."""
    if not len(x):
        return np.zeros(0, np.int64)
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(1, x.shape[1]) < EXACT:
        return np.einsum("ij,ij->i", x, y).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(u, v)) for u, v in zip(x.tolist(), y.tolist())], object).astype(np.int64)


class Search:
    """Queries of one dimension with thresholds, and the best rows that a task has found for them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, least: np.ndarray, k: int, turn: np.ndarray | None):
        self.ids, self.vectors, self.k, self.turn = ids, vectors, k, turn
        dim = vectors.shape[1]
        self.heads = sorted({max(1, int(dim * share)) for share in HEADS if dim}) if turn is not None else []
        self.rotated = vectors @ turn if self.heads else vectors
        self.left = lengths_from(self.rotated, self.heads) if self.heads else np.zeros((len(ids), 0))
        self.length = np.sqrt(np.square(vectors).sum(1))
        self.least = least.astype(np.float64)
        self.at, self.found, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.met = self.scored = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """A block of rows."""
        if max(np.abs(vectors).max(initial=0), np.abs(self.vectors).max(initial=0)) > HUGE:  # no bound holds in floats: every pair is scored
            return self.add_all(ids, vectors)
        length = np.sqrt(np.square(vectors).sum(1))
        order = np.argsort(-length, kind="stable")
        ids, vectors, length = ids[order], vectors[order], length[order]
        rotated = vectors @ self.turn if self.heads else vectors
        left = lengths_from(rotated, self.heads) if self.heads else np.zeros((len(ids), 0))
        new = []
        for top in range(0, len(ids), ROWS):
            for begin in range(0, len(self.ids), TILE):
                rows, tile = slice(top, top + ROWS), slice(begin, begin + TILE)
                row, query = self.may_reach(length[rows], rotated[rows], left[rows], vectors[rows], tile)
                own = ids[rows][row] != self.ids[query]
                row, query = row[own], query[own]
                for i in range(0, len(row), PAIRS):
                    part = slice(i, i + PAIRS)
                    score = products(vectors[rows][row[part]], self.vectors[query[part]])
                    stay = score >= self.least[query[part]]
                    new.append((query[part][stay], ids[rows][row[part]][stay], score[stay]))
                self.scored += len(row)
        if new:
            self.keep_best(*(np.concatenate(x) for x in zip(*new)))

    def may_reach(self, length, rotated, left, vectors, tile) -> tuple[np.ndarray, np.ndarray]:
        """Rows and queries of a tile whose products may reach the threshold, by bounds that tighten component by component until few are left."""
        own = self.length[tile]
        need = self.least[tile] - 1e-9 * (1 + own * length[0])
        n = int(np.searchsorted(-length * own.max(), -need.min(), side="right"))  # longer rows stand first
        self.met += len(length) * len(own)
        part = bound = np.zeros((n, len(own)))
        keep = length[:n, None] * own >= need
        for j, (a, b) in enumerate(zip([0, *self.heads], self.heads)):
            if np.count_nonzero(keep) <= FEW * keep.size:
                break
            part = part + rotated[:n, a:b] @ self.rotated[tile, a:b].T
            bound = left[:n, j, None] * self.left[tile, j]
            bound += part
            keep &= bound >= need
        if np.count_nonzero(keep) > FEW * keep.size:
            keep &= vectors[:n] @ self.vectors[tile].T >= need
        row, query = np.nonzero(keep)
        return row, query + tile.start

    def add_all(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for query in range(len(self.ids)):
            row = np.flatnonzero(ids != self.ids[query])
            score = products(vectors[row], np.broadcast_to(self.vectors[query], (len(row), vectors.shape[1])))
            self.keep_best(np.full(len(row), query), ids[row], score)

    def keep_best(self, at: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        at, found, score = np.concatenate([self.at, at]), np.concatenate([self.found, found]), np.concatenate([self.score, score])
        order = np.lexsort((found, -score, at))
        at, found, score = at[order], found[order], score[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        last = rank == self.k - 1
        self.least[at[last]] = np.maximum(self.least[at[last]], score[last])
        stay = rank < self.k
        self.at, self.found, self.score = at[stay], found[stay], score[stay]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.at), 50_000):
            part = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[self.at[part]]), pa.array(self.found[part]), pa.array(self.score[part])], names=["query_id", "vec_id", "score"])


def matrices(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and whole-number vectors of a batch, one dimension after the other."""
    ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    begins = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield ids[rows], flat[begins[rows][:, None] + np.arange(dim)]


def takes_part(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def rotation(rows: DataFrame, sample: int, scale: float) -> dict[int, np.ndarray]:
    """Orthogonal matrices by dimension, from a sample in hash order."""
    held: dict[int, list] = {}
    for row in rows.orderBy(F.xxhash64("vec_id", "embedding")).limit(sample).collect():
        held.setdefault(len(row[1]), []).append(np.floor(scale * np.array(row[1], np.float64)))
    out = {}
    for dim, vectors in held.items():
        top = max(np.abs(v).max(initial=0) for v in vectors) or 1.0
        if dim and np.isfinite(top):
            x = np.stack(vectors) / top
            out[dim] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return out


def doubling(first: int, end: int) -> Iterator[tuple[int, int]]:
    """Ranges that double, so that thresholds rise while few rows have been met."""
    a, b = 0, first
    while a < end:
        yield a, b
        a, b = b, 2 * b


def seeded(queries: DataFrame, longest: DataFrame, k: int, scale: float, turns: dict) -> DataFrame:
    """Queries with the k-th best score that they reach among the longest vectors, as a first threshold."""
    spark = session_of(queries)
    held: dict[int, tuple[list, list]] = {}
    for row in longest.collect():  # SEEDS rows at most
        ids, vectors = held.setdefault(len(row[1]), ([], []))
        ids.append(row[0])
        vectors.append(np.floor(scale * np.array(row[1], np.float64)))
    shared = spark.sparkContext.broadcast({dim: (np.array(ids, np.int64), np.stack(vectors)) for dim, (ids, vectors) in held.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            least = np.full(len(sizes), -np.inf)
            for ids, vectors in matrices(batch, scale):
                dim = vectors.shape[1]
                if dim in shared.value:
                    for i in range(0, len(ids), TILE):
                        search = Search(ids[i : i + TILE], vectors[i : i + TILE], np.full(len(ids[i : i + TILE]), -np.inf), k, turns.get(dim))
                        for a, b in doubling(4 * k, len(shared.value[dim][0])):
                            search.add(*(x[a:b] for x in shared.value[dim]))
                        least[np.flatnonzero(sizes == dim)[i : i + TILE]] = search.least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least)], names=["vec_id", "embedding", "least"])

    return queries.mapInArrow(run, "vec_id bigint, embedding array<double>, least double")


def _run(shared, k: int, scale: float, turns: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {dim: Search(ids, vectors, least, k, turns.get(dim)) for dim, (ids, vectors, least) in shared.value.items()}
        held: dict[int, list] = {dim: [] for dim in searches}

        def work(dim: int, least: int) -> None:
            while held[dim] and sum(len(x[0]) for x in held[dim]) >= least:
                ids, vectors = (np.concatenate(x) for x in zip(*held[dim]))
                searches[dim].add(ids[:BLOCK], vectors[:BLOCK])
                held[dim] = [(ids[BLOCK:], vectors[BLOCK:])] if len(ids) > BLOCK else []

        for batch in batches:
            for ids, vectors in matrices(batch, scale):
                if (dim := vectors.shape[1]) in searches:
                    held[dim].append((ids, vectors))
                    work(dim, BLOCK)
        for dim, search in searches.items():
            work(dim, 1)
            yield from search.batches()

    return run


def parts(queries: DataFrame, most_bytes: int, scale: float) -> Iterator[dict]:
    """The seeded queries by dimension, in chunks of bounded size."""
    packed = queries.select("vec_id", F.concat(F.array(F.col("least")), "embedding").alias("v"))
    for part in chunks(packed, most_bytes):
        yield {dim - 1: (ids, np.floor(scale * v[:, 1:]), v[:, 0]) for dim, (ids, v) in part.items()}


def best_products(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = SCALE, chunk_bytes: int = CHUNK_BYTES, seeds: int = SEEDS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows with the greatest inner product for each query."""
    spark = session_of(vectors)
    ship(spark)
    rows = pick(vectors, key, vector).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & takes_part(F.col("embedding")))
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    turns = rotation(rows, sample, scale)
    longest = rows.orderBy(F.desc(length), "vec_id").limit(seeds)
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sorted_rows = rows.sortWithinPartitions(F.desc(length))
    found = None
    for part in parts(seeded(queries, longest, k, scale, turns), chunk_bytes, scale):
        own = sorted_rows.mapInArrow(_run(spark.sparkContext.broadcast(part), k, scale, turns), SCHEMA)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_products(spark, sf_dir: str) -> DataFrame:
    return best_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


WHOLE = "embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
OP13_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) e FROM embeddings WHERE {WHOLE}),
q AS (SELECT vec_id, min(e) e FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id query_id, v.vec_id, coalesce(list_dot_product(q.e, v.e), 0)::BIGINT score FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
