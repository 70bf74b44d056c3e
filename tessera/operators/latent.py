"""Embeddings learned from the corpus itself (N6, N7): latent directions of weighted token counts by a randomised SVD.

A token's slot is its hash modulo ``slots``. A row of the matrix holds, for each slot, 1 + ln(count) times ln(1 + rows / rows with the slot),
scaled to length 1. Only products with the whole matrix A are needed: each pass gives every task its own partial of
``A' (A Q)``, ``slots`` rows of ``dim + EXTRA`` numbers, and Spark sums them by slot. Slots and directions are fixed in number, so
what comes to the driver (``slots`` x ``dim + EXTRA`` doubles: 5 MB) doesn't grow with the corpus, and neither does what is broadcast. Texts
aren't shuffled. Between passes the driver makes the directions orthogonal again; after the last one they are turned into those
of the singular values, the largest first, each with its greatest component positive.

Where singular values lie close together more passes are needed to tell them apart; ``PASSES`` are enough for the space as a whole.
A vector is a row's projection, scaled to length 1. Rows to embed needn't have been learned from: questions get vectors by the
same directions. A null text, one without tokens or one all of whose slots are unknown has the zero vector, as has every text of an empty corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.cluster import send_package
from tessera.operators.bm25 import tokens

SLOTS, DIM, EXTRA, PASSES = 16384, 32, 8, 3
TOKENS = 1 << 15  # tokens multiplied at once
ROWS = 64  # rows of a dense matrix, which has no more columns than these have tokens or ``slots``: 16 MB for TOKENS


def slotted(rows: DataFrame, key: str, text: str, slots: int, stop_words: list[str] | None) -> DataFrame:
    """key, slots: the slot of every token of a text."""
    found = F.transform(tokens(F.col(text), stop_words), lambda t: F.pmod(F.xxhash64(t), F.lit(slots)).cast("int"))
    return rows.select(F.col(key).alias("key"), F.coalesce(found, F.array().cast("array<int>")).alias("slots"))


class Part:
    """Some rows of the matrix, ``ROWS`` at a time as (first row, slots that these rows have, dense matrix of both)."""

    def __init__(self, lists: list[np.ndarray], weights: np.ndarray):
        size = len(weights)
        self.height = len(lists)
        places = np.repeat(np.arange(len(lists)) * size, [len(x) for x in lists]) + np.concatenate(lists)
        places, counts = np.unique(places, return_counts=True)
        row, slot = np.divmod(places, size)
        value = (1 + np.log(counts)) * weights[slot]
        norms = np.sqrt(np.bincount(row, value * value, len(lists)))[row]
        value = np.divide(value, norms, out=np.zeros_like(value), where=norms > 0)
        self.blocks = []
        firsts = np.arange(0, self.height, ROWS)
        for first, a, b in zip(firsts, np.searchsorted(row, firsts), np.searchsorted(row, firsts + ROWS)):
            slots, at = np.unique(slot[a:b], return_inverse=True)
            matrix = np.zeros((min(ROWS, self.height - first), len(slots)))
            matrix[row[a:b] - first, at] = value[a:b]
            self.blocks.append((first, slots, matrix))

    def times(self, q: np.ndarray) -> np.ndarray:
        """A q of these rows."""
        return np.concatenate([matrix @ q[slots] for _, slots, matrix in self.blocks])

    def add_back(self, y: np.ndarray, total: np.ndarray) -> None:
        """A' y of these rows, added to ``total``."""
        for first, slots, matrix in self.blocks:
            total[slots] += matrix.T @ y[first : first + len(matrix)]


def parts(frames: Iterator[pd.DataFrame], weights: np.ndarray) -> Iterator[tuple[pd.DataFrame, Part]]:
    """Rows with their part of the matrix, about ``TOKENS`` tokens at a time."""
    for frame in frames:
        lists = [np.asarray(s, np.int64) for s in frame["slots"]]
        group = np.cumsum([len(x) for x in lists]) // TOKENS
        ends = [*np.flatnonzero(np.diff(group)) + 1, len(lists)]
        for a, b in zip([0, *ends[:-1]], ends):
            if b > a:
                yield frame.iloc[a:b], Part(lists[a:b], weights)


class Directions:
    """What was learned: a weight for each slot, directions (slots x dim) and their singular values."""

    def __init__(self, weights: np.ndarray, basis: np.ndarray, values: np.ndarray, stop_words: list[str] | None):
        self.weights, self.basis, self.values, self.stop_words = weights, basis, values, stop_words

    def embed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """Key, embedding. No shuffle."""
        return self.project(slotted(rows, key, text, len(self.weights), self.stop_words), key)

    def project(self, found: DataFrame, key: str) -> DataFrame:
        """key, embedding of rows as ``slotted`` tells them."""
        send_package(found.sparkSession)
        told = found.sparkSession.sparkContext.broadcast((self.weights, self.basis))

        def project(frames):
            weights, basis = told.value
            for frame, part in parts(frames, weights):
                vectors = part.times(basis)
                norms = np.sqrt((vectors * vectors).sum(1, keepdims=True))
                vectors = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 1e-12)
                yield pd.DataFrame({"key": frame["key"], "embedding": list(vectors)})

        out = found.mapInPandas(project, found.select("key", F.array(F.lit(0.0)).alias("embedding")).schema)
        return out.withColumnRenamed("key", key)


def slot_weights(found: DataFrame, slots: int) -> np.ndarray:
    """ln(1 + rows / rows with the slot); 0 for slots that no row has."""
    counted = found.select(F.explode(F.array_distinct("slots")).alias("slot")).groupBy("slot").agg(F.count("*").alias("df")).toPandas()  # at most ``slots`` rows
    total, df = found.count(), np.zeros(slots)
    df[counted["slot"].to_numpy(np.int64)] = counted["df"]
    return np.where(df > 0, np.log1p(total / np.maximum(df, 1)), 0.0)


def product(found: DataFrame, weights: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A' (A q), summed over all tasks by slot."""
    told = found.sparkSession.sparkContext.broadcast((weights, q))
    names = [f"c{i}" for i in range(q.shape[1])]

    def partial(frames):
        weights, q = told.value
        total = np.zeros_like(q)
        for _, part in parts(frames, weights):
            part.add_back(part.times(q), total)
        some = np.flatnonzero(np.abs(total).sum(1))
        yield pd.DataFrame(total[some], columns=names).assign(slot=some)[["slot", *names]]

    partials = found.mapInPandas(partial, "slot long, " + ", ".join(f"{n} double" for n in names))
    sums = partials.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # at most ``slots`` rows
    told.unpersist()
    out = np.zeros_like(q)
    out[sums["slot"].to_numpy(np.int64)] = sums[names].to_numpy()
    return out


def learn(rows: DataFrame, text: str, slots: int = SLOTS, dim: int = DIM, passes: int = PASSES, seed: int = 7, stop_words: list[str] | None = None, keep=lambda x: x) -> Directions:
    """Directions of all rows' texts. ``keep`` makes a table of the slots, so that texts are split into tokens once."""
    return learned(keep(slotted(rows, text, text, slots, stop_words).select("slots")), slots, dim, passes, seed, stop_words)


def embedded(rows: DataFrame, key: str, text: str, keep, slots: int = SLOTS, dim: int = DIM, passes: int = PASSES, seed: int = 7, stop_words: list[str] | None = None) -> DataFrame:
    """Key, embedding of the rows by directions learned from them; texts are split into tokens once for both."""
    found = keep(slotted(rows, key, text, slots, stop_words))
    return learned(found, slots, dim, passes, seed, stop_words).project(found, key)


def learned(found: DataFrame, slots: int, dim: int, passes: int, seed: int, stop_words: list[str] | None) -> Directions:
    """Directions of rows as ``slotted`` tells them."""
    send_package(found.sparkSession)
    weights = slot_weights(found, slots)
    start = np.random.default_rng(seed).standard_normal((slots, min(dim + EXTRA, slots))) * (weights > 0)[:, None]
    q = np.linalg.qr(start)[0]
    for _ in range(passes):
        q = np.linalg.qr(product(found, weights, q))[0]
    values, turn = np.linalg.eigh((lambda m: (m + m.T) / 2)(q.T @ product(found, weights, q)))
    best = np.argsort(-values, kind="stable")[:dim]
    basis = q @ turn[:, best]
    basis *= np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1.0, 1.0)
    values = np.sqrt(np.maximum(values[best], 0))
    return Directions(weights, basis * (values > 1e-9), values, stop_words)
