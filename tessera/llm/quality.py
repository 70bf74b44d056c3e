"""Quality classifier: a factorisation machine over hashed words, word shapes, structure statistics and text size.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)), so a text costs time in
proportion to its distinct words times the rank. Everything up to the sums is vectorised over a batch of texts.

Learned from a bounded sample of labelled rows in hash order; a text too long for what is left of the bound is passed over. Null and empty texts have no words and are scored on their
statistics. Without any labelled row, every score is 0.5. Rows are judged one by one, so repeated rows get equal
results; several labels of one document each count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import numbered, pick, session_of, ship

#: Bounds of the training sample: labelled rows and bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 5000, 32 << 20
WORD_BITS, SHAPES, BINS, RANK = 16, 1 << 10, 12, 6
STATS = ("words", "chars", "word_length", "distinct", "upper", "symbol", "digit", "other", "lines", "line_words", "repeats", "odd_ends")
EPOCHS, STEPS, BATCH, RATE, DECAY = 6, 700, 64, 0.08, 1e-5  # at least so many epochs and so many steps

N_FEATURES = (1 << WORD_BITS) + SHAPES + len(STATS) * BINS
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.arange(256, dtype=np.uint64) + np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), 32, 0).astype(np.uint64)
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
OTHER = np.arange(256) >= 128
SYMBOL = (np.arange(256) > 32) & (np.arange(256) < 127) & ~UPPER & ~DIGIT & ~((np.arange(256) >= 97) & (np.arange(256) <= 122))
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, features and values of word and shape features (values of a row have norm 1 each), and statistics (texts, STATS)."""
    n = len(texts)
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    solid = ~SPACE[buffer]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    stats = np.zeros((n, len(STATS)))
    lines = np.add.reduceat((buffer == 10).astype(np.int64), begins)
    stats[:, 1] = np.log1p(sizes)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), stats
    length = ends - starts
    doc = np.searchsorted(begins, starts, side="right") - 1
    words = np.bincount(doc, minlength=n)
    bounds = np.stack([starts, ends], 1).ravel()

    def of_word(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.append(flags, 0), bounds)[::2].astype(np.int64)

    nth = np.arange(len(buffer), dtype=np.int64) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(buffer)]])))
    mixed = (LOWER[buffer] + np.uint64(1)) * POWERS[nth & 63]
    h = np.add.reduceat(np.append(mixed, np.uint64(0)), bounds)[::2]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    counts = np.zeros(len(buffer) + 1, np.uint64)  # four counters of 16 bits in one sum; words over 65535 bytes only blur their shape
    counts[:-1] = (UPPER.astype(np.uint64) | (SYMBOL.astype(np.uint64) << np.uint64(16)) | (DIGIT.astype(np.uint64) << np.uint64(32)) | (OTHER.astype(np.uint64) << np.uint64(48)))[buffer]
    packed = np.add.reduceat(counts, bounds)[::2]
    upper, symbol, digit, other = [((packed >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64) for k in range(4)]
    last = buffer[ends - 1].astype(np.int64)
    shape = (np.minimum(symbol, 3) + 4 * (digit > 0) + 8 * ((upper > 1) & (2 * upper >= length)) + 16 * np.where(SYMBOL[last], last % 32, 0)).astype(np.int64)
    word = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])

    def by_doc(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=x, minlength=n)

    pairs = np.concatenate([doc * N_FEATURES + word, doc * N_FEATURES + (1 << WORD_BITS) + shape])
    found, count = np.unique(pairs, return_counts=True)
    rows, ids = found // N_FEATURES, found % N_FEATURES
    value = count.astype(np.float64)
    group = 2 * rows + (ids >= 1 << WORD_BITS)
    value /= np.sqrt(np.bincount(group, weights=value * value, minlength=2 * n))[group]
    distinct = np.bincount(rows[ids < 1 << WORD_BITS], minlength=n)
    size, total = np.maximum(sizes, 1), np.maximum(words, 1)
    odd = SYMBOL[last] & ~np.isin(last, [33, 34, 39, 41, 44, 46, 58, 59, 63])
    stats[:] = np.stack(
        [np.log1p(words), np.log1p(sizes), by_doc(length) / total, distinct / total**0.8, by_doc(upper) / size, by_doc(symbol) / size,
         by_doc(digit) / size, by_doc(other) / size, np.log1p(lines), words / np.maximum(lines, 1), by_doc(same) / total, by_doc(odd) / total],
        1,
    )
    return rows, ids, value.astype(np.float32), stats


def inputs(texts: list[bytes], edges: np.ndarray):
    """All features of a batch, statistics as one feature for each bin."""
    rows, ids, values, stats = features(texts)
    bins = np.stack([np.searchsorted(edges[k], stats[:, k]) for k in range(len(STATS))], 1)
    at = (1 << WORD_BITS) + SHAPES + np.arange(len(STATS)) * BINS + bins
    n = len(texts)
    rows = np.concatenate([rows, np.repeat(np.arange(n), len(STATS))])
    ids = np.concatenate([ids, at.ravel()])
    values = np.concatenate([values, np.full(n * len(STATS), 0.5, np.float32)])
    order = np.argsort(rows, kind="stable")
    return rows[order], ids[order], values[order]


def sums(model: dict, rows: np.ndarray, ids: np.ndarray, values: np.ndarray, n: int):
    """Raw score of each row, and the sums by factor; every row has features, in order."""
    starts = np.searchsorted(rows, np.arange(n))
    vx = model["v"][ids] * values[:, None]
    by_factor = np.add.reduceat(vx, starts)
    squares = np.add.reduceat((vx * vx).sum(1), starts)
    linear = np.add.reduceat(model["w"][ids] * values, starts)
    return model["w0"] + linear + 0.5 * ((by_factor**2).sum(1) - squares), by_factor


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 5) -> dict | None:
    """AdaGrad on the log loss, by the features of each batch, a rare label weighs more, by the root of how rare it is; where there is one label only, it starts from its log odds."""
    if not texts:
        return None
    ones = float(labels.sum())
    odds = (ones + 0.5) / (len(labels) - ones + 0.5)
    weight = np.sqrt(np.where(labels > 0.5, len(labels) / max(2 * ones, 1), len(labels) / max(2 * (len(labels) - ones), 1))).astype(np.float32)
    if ones in (0, len(labels)):
        weight[:] = 1
    rng = np.random.default_rng(seed)
    stats = np.concatenate([features(texts[i : i + 500])[3] for i in range(0, len(texts), 500)])
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    model = {"edges": edges, "w0": float(np.log(odds)) if ones in (0, len(labels)) else 0.0, "w": np.zeros(N_FEATURES, np.float32), "v": rng.normal(0, 0.05, (N_FEATURES, RANK)).astype(np.float32)}
    seen = {"w0": 1e-2, "w": np.full(N_FEATURES, 1e-2, np.float32), "v": np.full((N_FEATURES, RANK), 1e-2, np.float32)}
    order = rng.permutation(len(texts))
    parts = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    given = [inputs([texts[k] for k in part], edges) for part in parts]
    for _ in range(max(EPOCHS, -(-STEPS // len(parts)))):
        for at in rng.permutation(len(parts)):
            part, (rows, ids, values) = parts[at], given[at]
            raw, by_factor = sums(model, rows, ids, values, len(part))
            g = ((sigmoid(raw) - labels[part]) * weight[part] / len(part)).astype(np.float32)
            own, back = np.unique(ids, return_inverse=True)
            gx = g[rows] * values
            g_w = np.bincount(back, weights=gx, minlength=len(own)).astype(np.float32) + DECAY * model["w"][own]
            each = gx[:, None] * (by_factor[rows] - model["v"][ids] * values[:, None])
            g_v = np.stack([np.bincount(back, weights=each[:, f], minlength=len(own)) for f in range(RANK)], 1).astype(np.float32) + DECAY * model["v"][own]
            seen["w"][own] += g_w**2
            seen["v"][own] += g_v**2
            seen["w0"] += float(g.sum()) ** 2
            model["w"][own] -= RATE * g_w / np.sqrt(seen["w"][own])
            model["v"][own] -= RATE * g_v / np.sqrt(seen["v"][own])
            model["w0"] -= RATE * float(g.sum()) / seen["w0"] ** 0.5
    return model


def score_texts(model: dict | None, texts: list[bytes], at_once: int = 400) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    out = [sigmoid(sums(model, *inputs(part, model["edges"]), len(part))[0]) for part in (texts[i : i + at_once] for i in range(0, len(texts), at_once))]
    return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def training_rows(documents: DataFrame, labels: DataFrame, label: str, key: str, text: str, rows: int, most_bytes: int):
    """Labelled texts: of the ``rows`` labels of least hash, in that order, those whose texts fit into what is left of ``most_bytes``."""
    order = F.xxhash64(F.col(key).cast("string"), F.lit("quality"))
    own = pick(labels, key, label).filter(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    own = own.orderBy(order, key, label).limit(rows)
    found = pick(documents, key, text).join(F.broadcast(own), key)  # the sample's bound is the broadcast's
    texts, marks, left = [], [], most_bytes
    for row in found.filter(F.coalesce(F.octet_length(text), F.lit(0)) <= most_bytes).orderBy(order, key, label, text).select(text, label).toLocalIterator():
        raw = (row[0] or "").encode("utf-8", "surrogatepass")
        if len(raw) <= left:
            left -= len(raw)
            texts.append(raw)
            marks.append(row[1])
    return texts, np.array(marks, np.float32)


def train(
    documents: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
    rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES,
) -> dict | None:
    return fit(*training_rows(documents, labels, label, key, text, rows, most_bytes))


def score(documents: DataFrame, model: dict | None, text: str = "text", into: str = "quality_score") -> DataFrame:
    """Documents with a double column ``into``: the probability of label 1."""
    spark = session_of(documents)
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]
            yield pa.array(score_texts(shared.value, raw), pa.float64())

    own, (at,) = numbered(documents, text)
    return own.withColumn(into, run(F.col(at))).toDF(*documents.columns, into)


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    documents = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").withColumn("held_out", held_out("doc_id"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(documents.filter(~F.col("held_out")), pick(labels, "doc_id", "quality").filter(~held_out("doc_id")))
    out = score(documents, model, into="score")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
