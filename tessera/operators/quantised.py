"""Dense retrieval over binary codes, rescored with the whole vectors.

A code holds the sign of each component and, where that is fewer than ``BITS``, the signs of sums of the components
with fixed signs of their own: short vectors need more bits than they have components for distances that tell near from far. Codes are packed
in longs and compared by the bits of ``a ^ b``.

A search reads the codes twice. First it counts, for each query, the rows at each distance: a few thousand counters, no sort. The
radius up to which there are ``OVERSAMPLE`` times as many rows as wanted comes from these counts. Then it takes the rows within that
radius, the nearest codes first (ties to the smaller key), and ranks them by exact cosine. Queries meet the codes in blocks of
``QUERIES`` that are broadcast, two passes over the codes for each; vectors are only read for candidates.

Vectors that are null or empty have no code and aren't found; a zero or null component's sign is that of a negative one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.cluster import send_package
from tessera.operators.bm25 import top
from tessera.operators.retrieval import dot, norm

BITS, OVERSAMPLE, QUERIES, TILE = 2048, 4, 2000, 64
PRIME = (1 << 31) - 1


def fixed_signs(components: int, sums: int) -> np.ndarray:
    """+1 or -1 for each component and sum, from whole numbers that any engine can compute."""
    i, j = np.arange(components, dtype=np.int64)[:, None], np.arange(sums, dtype=np.int64)[None, :]
    h = ((i + 1) * 1103515245 + (j + 1) * 809050113) % PRIME
    h = (h * h + 12345) % PRIME
    return np.where((h * h + i + 1) % PRIME * 2 > PRIME, 1.0, -1.0)


def packed_signs(vectors: np.ndarray, bits: int) -> np.ndarray:
    """The codes of vectors of one length: (vectors, longs); the first sign is a long's lowest bit."""
    more = max(0, bits - vectors.shape[1])
    signs = np.concatenate([vectors, vectors @ fixed_signs(vectors.shape[1], more)], 1) > 0
    signs = np.pad(signs, ((0, 0), (0, -signs.shape[1] % 64)))
    return np.packbits(signs, axis=1, bitorder="little").view("<i8")


def code(vector: Column, bits: int = BITS) -> Column:
    """The code of a vector as longs; null for null and empty vectors."""

    @F.pandas_udf("array<bigint>")
    def of(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        sizes = vectors.map(lambda v: 0 if v is None else len(v)).to_numpy()
        for size in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == size)
            for i in range(0, len(at), 1024):
                part = at[i : i + 1024]
                found = packed_signs(np.nan_to_num(np.stack([np.asarray(v, np.float64) for v in vectors.iloc[part]]), nan=0.0), bits)
                for k, row in zip(part, found):
                    out.iloc[k] = row
        return out

    return of(vector.cast("array<double>"))


def unpacked(column: pa.Array, longs: int) -> np.ndarray:
    """An Arrow array of codes of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, longs)


def distances(rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Bits in which codes differ: (rows, asked)."""
    out = np.zeros((len(rows), len(asked)), np.int32)
    for a, b in zip(rows.T, asked.T):
        out += np.bitwise_count(a[:, None] ^ b[None, :])
    return out


def _counted(shared, bits: int):
    """query, distance, n of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, _ = shared.value
        counts = np.zeros((len(ids), bits + 1), np.int64)
        for batch in batches:
            rows = unpacked(batch.column(1), asked.shape[1])
            for i in range(0, len(ids), TILE):
                found = distances(rows, asked[i : i + TILE]) + np.arange(len(asked[i : i + TILE])) * (bits + 1)
                counts[i : i + TILE] += np.bincount(found.ravel(), minlength=counts[i : i + TILE].size).reshape(-1, bits + 1)
        query, distance = np.nonzero(counts)
        yield from pa.table({"query": pa.array(query.astype(np.int32)), "distance": pa.array(distance.astype(np.int32)), "n": counts[query, distance]}).to_batches(50_000)

    return run


def _within(shared):
    """query, doc, distance of a task's rows inside each query's radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, radius = shared.value
        for batch in batches:
            rows = unpacked(batch.column(1), asked.shape[1])
            for i in range(0, len(ids), TILE):
                found = distances(rows, asked[i : i + TILE])
                row, query = np.nonzero(found <= radius[i : i + TILE])
                yield pa.RecordBatch.from_arrays([pa.array((query + i).astype(np.int32)), batch.column(0).take(pa.array(row)), pa.array(found[row, query])], names=["at", "doc", "distance"])

    return run


class Codes:
    """A collection's codes: doc, size (components), code; kept as a table, so that vectors are read once to make them."""

    def __init__(self, chunks: DataFrame, keep, bits: int = BITS):
        send_package(chunks.sparkSession)
        self.chunks, self.bits, self.keep = chunks, bits, keep
        self.codes = keep(chunks.select("doc", F.size("vec").alias("size"), code(F.col("vec"), bits).alias("code")).filter("code is not null"))

    def candidates(self, queries: DataFrame, most: int, allowed: DataFrame | None = None, most_queries: int = QUERIES) -> DataFrame:
        """query, doc, distance: the ``most`` nearest codes of each query. queries: query, qvec; allowed: the docs that may be found."""
        rows = self.codes if allowed is None else self.codes.join(allowed.select("doc").distinct(), "doc", "left_semi")
        own = queries.select("query", F.size("qvec").alias("qsize"), code(F.col("qvec"), self.bits).alias("qcode")).filter("qcode is not null")
        own = self.keep(own)
        known = own.groupBy("qsize").agg(F.count("*").alias("n")).collect()  # one row for each length of vector
        out, kind = own.select("query").join(self.codes.select("doc").limit(0)).withColumn("distance", F.lit(0)), dict(rows.dtypes)["doc"]
        for size, n in known:
            bits = -(-max(self.bits, size) // 64) * 64
            blocks = max(1, -(-n // most_queries))
            codes = rows.filter(F.col("size") == size).select("doc", "code")
            for i in range(blocks):
                block = own.filter((F.col("qsize") == size) & (F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)).select("query", "qcode").toArrow()
                if not block.num_rows:
                    continue
                ids, asked = block["query"].to_pylist(), unpacked(block["qcode"].combine_chunks(), bits // 64)
                spark = rows.sparkSession
                counts = codes.mapInArrow(_counted(spark.sparkContext.broadcast((ids, asked, None)), bits), "query int, distance int, n bigint").groupBy("query", "distance").agg(F.sum("n").alias("n"))
                before = F.sum("n").over(Window.partitionBy("query").orderBy("distance")) - F.col("n")  # one row for each distance
                reach = counts.withColumn("before", before).filter(F.col("before") < most).groupBy("query").agg(F.max("distance")).collect()  # one row for each query of the block
                radius = np.full(len(ids), -1)
                for query, most_distant in reach:
                    radius[query] = most_distant
                found = codes.mapInArrow(_within(spark.sparkContext.broadcast((ids, asked, radius))), f"at int, doc {kind}, distance int")
                names = spark.createDataFrame(list(enumerate(ids)), f"at int, query {dict(own.dtypes)['query']}")
                out = out.unionByName(found.join(F.broadcast(names), "at").drop("at"))
        order = Window.partitionBy("query").orderBy("distance", "doc")
        return out.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most).drop("__n")

    def search(self, queries: DataFrame, limit: int, oversample: int = OVERSAMPLE, allowed: DataFrame | None = None, most_queries: int = QUERIES) -> DataFrame:
        """query, doc, score, rank by exact cosine among the candidates."""
        near = self.candidates(queries, limit * oversample, allowed, most_queries)
        full = near.join(self.chunks.select("doc", "vec"), "doc").join(queries.select("query", "qvec"), "query")
        score = F.round(dot(F.col("qvec"), F.col("vec")) / (norm(F.col("vec")) * norm(F.col("qvec"))), 6)
        return top(full.select("query", "doc", score.alias("score")), limit)
