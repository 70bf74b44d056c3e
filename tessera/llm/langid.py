"""Language identification: a bidirectional gated recurrent network over bytes.

Both directions read windows of ``WINDOW`` bytes that together cover the whole text; every byte position gets a
distribution over the languages, and a document's probability is the mean over all its positions. Training is
backpropagation through time in numpy over windows of a bounded, hashed sample of the labelled rows.

Null text and text without a letter: ``und`` with score 0. Empty tables and tables without a labelled row: ``und``
for all. Rows are judged one by one, so repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import numbered, pick, session_of, ship

HIDDEN, WINDOW = 8, 128
#: Bounds of the training sample: about so many rows of each language, and bytes in all, which the languages share evenly.
SAMPLE_ROWS, SAMPLE_BYTES = 300, 24 << 20
STEPS, TRAIN_WINDOW, TRAIN_BATCH, RATE = 160, 48, 256, 0.02
UNKNOWN = "und"
WORD_SIGN = re.compile(r"[^\W\d_]")
RESULT = "lang string, score double"


def has_letter(text: str) -> bool:
    """Any character of the Unicode category L; fractions and raised digits are none."""
    return any(m[0].isalpha() for m in WORD_SIGN.finditer(text))


def squash(x: np.ndarray, spare: np.ndarray) -> None:
    """x / (1 + |x|) in place: the shape of tanh at a fifth of its price; its slope is (1 - |y|) squared."""
    np.abs(x, out=spare)
    spare += 1
    x /= spare


def init(n_langs: int, hidden: int, rng) -> dict[str, np.ndarray]:
    """x: input terms by byte; u: recurrent weights; b: bias inside the reset; o: output weights. The first axis is the direction."""
    h = hidden
    return {
        "x": rng.normal(0, 0.3, (2, 3 * h, 256)).astype(np.float32),
        "u": rng.normal(0, h**-0.5, (2, 3 * h, h)).astype(np.float32),
        "b": np.zeros((2, h, 1), np.float32),
        "o": rng.normal(0, 0.3, (2, n_langs, h)).astype(np.float32),
        "c": np.zeros((n_langs, 1), np.float32),
    }


def forward(p: dict, codes: np.ndarray, keep: bool, mask: np.ndarray | None = None):
    """codes: (time, batch) bytes. Returns logits (time, languages, batch) and, if asked, what the backward pass needs."""
    steps, batch = codes.shape
    h = p["u"].shape[2]
    logits = np.empty((steps, p["c"].shape[0], batch), np.float32)
    logits[:] = p["c"]
    state = np.zeros((2, h, batch), np.float32)
    x = np.empty((2, 3 * h, batch), np.float32)
    spare = np.empty((2, 2 * h, batch), np.float32)
    tape = []
    for t in range(steps):
        at = (t, steps - 1 - t)
        for d in (0, 1):
            np.take(p["x"][d], codes[at[d]], axis=1, out=x[d], mode="clip")
        a = p["u"] @ state
        gates = x[:, : 2 * h]
        gates += a[:, : 2 * h]
        squash(gates, spare)
        gates *= 0.5
        gates += 0.5
        z, r = gates[:, :h], gates[:, h:]
        inner = a[:, 2 * h :]
        inner += p["b"]
        fresh = r * inner
        fresh += x[:, 2 * h :]
        squash(fresh, spare[:, :h])
        if keep:
            tape.append((state, z.copy(), r.copy(), inner.copy(), fresh.copy()))
            state = fresh + z * (state - fresh)
        else:
            state -= fresh
            state *= z
            state += fresh
        if mask is not None:
            state[0] *= mask[at[0]]
            state[1] *= mask[at[1]]
        for d in (0, 1):
            logits[at[d]] += p["o"][d] @ state[d]
        if keep:
            tape[-1] += (state,)
    return logits, tape


def backward(p: dict, codes: np.ndarray, g_logits: np.ndarray, tape: list) -> dict[str, np.ndarray]:
    """Gradients by backpropagation through time."""
    steps, batch = codes.shape
    h = p["u"].shape[2]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["c"] = g_logits.sum((0, 2))[:, None]
    g_state = np.zeros((2, h, batch), np.float32)
    for t in reversed(range(steps)):
        before, z, r, inner, fresh, state = tape[t]
        at = (t, steps - 1 - t)
        for d in (0, 1):
            g["o"][d] += g_logits[at[d]] @ state[d].T
            g_state[d] += p["o"][d].T @ g_logits[at[d]]
        g_fresh = g_state * (1 - z) * np.square(1 - np.abs(fresh))
        g_z = g_state * (before - fresh) * 0.5 * np.square(1 - np.abs(2 * z - 1))
        g_inner = g_fresh * r
        g_r = g_fresh * inner * 0.5 * np.square(1 - np.abs(2 * r - 1))
        g_a = np.concatenate([g_z, g_r, g_inner], 1)
        g_x = np.concatenate([g_z, g_r, g_fresh], 1)
        g["b"] += g_inner.sum(2, keepdims=True)
        g["u"] += g_a @ before.transpose(0, 2, 1)
        g_state = g_state * z + p["u"].transpose(0, 2, 1) @ g_a
        for d in (0, 1):
            one_hot = np.zeros((batch, 256), np.float32)
            one_hot[np.arange(batch), codes[at[d]]] = 1
            g["x"][d] += g_x[d] @ one_hot
    return g


def softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def fit(texts: list[bytes], langs: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> dict | None:
    """Train on windows of the texts; a language counts as much as any other."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    p = init(len(names), hidden, rng)
    joined = {n: np.frombuffer(b" ".join(t for t, x in zip(texts, langs) if x == n) or b" ", np.uint8) for n in names}
    joined = {n: np.resize(v, max(len(v), TRAIN_WINDOW + 1)) for n, v in joined.items()}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        y = rng.integers(0, len(names), TRAIN_BATCH)
        codes = np.empty((TRAIN_WINDOW, TRAIN_BATCH), np.uint8)
        for b, k in enumerate(y):
            v = joined[names[k]]
            at = rng.integers(0, len(v) - TRAIN_WINDOW)
            codes[:, b] = v[at : at + TRAIN_WINDOW]
        logits, tape = forward(p, codes, True)
        g = softmax(logits)
        g[:, y, np.arange(TRAIN_BATCH)] -= 1
        g /= codes.size
        rate = RATE * min(1, 2 * (1 - (step - 1) / steps))
        for k, v in backward(p, codes, g, tape).items():
            m[k] += 0.1 * (v - m[k])
            s[k] += 0.01 * (v * v - s[k])
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)
    return {"names": names, "p": p}


def position_sums(p: dict, texts: list[bytes], window: int = WINDOW, batch: int = 4096) -> np.ndarray:
    """Mean distribution over all byte positions of each text: (texts, languages)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    whole = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(sizes) - sizes
    count = -(-sizes // window)
    doc = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    at = starts[doc] + nth * window
    size = np.minimum(sizes[doc] - nth * window, window)
    sums = np.zeros((len(texts), p["c"].shape[0]))
    padded = np.concatenate([whole, np.zeros(window, np.uint8)])
    order = np.argsort(-size, kind="stable")  # windows of like size together
    for i in range(0, len(order), batch):
        part = order[i : i + batch]
        n = size[part]
        steps = int(n[0])
        codes = np.ascontiguousarray(padded[at[part][None, :] + np.arange(steps)[:, None]])
        mask = None if n[-1] == steps else (np.arange(steps)[:, None] < n[None, :]).astype(np.float32)
        shares = softmax(forward(p, codes, False, mask)[0])
        if mask is not None:
            shares *= mask[:, None, :]
        np.add.at(sums, doc[part], shares.sum(0).T)
    return sums / np.maximum(sizes, 1)[:, None]


def training_rows(documents: DataFrame, lang: str, text: str, key: str, rows: int, most_bytes: int) -> tuple[list, list]:
    """A hashed sample with about as many rows of each language, in hash order; a text too long for what its language has left is passed over."""
    labelled = documents.filter(F.col(lang).isNotNull() & (F.length(text) > 0))
    rates = labelled.groupBy(lang).agg(F.count("*").alias("__n")).select(F.col(lang).alias("__lang"), (F.lit(rows) / F.col("__n")).alias("__rate"))
    order = F.xxhash64(F.col(key).cast("string"), F.lit("langid"))
    draw = F.pmod(order, F.lit(1_000_003)) / 1_000_003
    found = labelled.join(F.broadcast(rates), F.col(lang) == F.col("__lang")).filter(draw < F.col("__rate"))  # one row for each language
    names = [r[0] for r in rates.select("__lang").collect()]
    left, texts, langs = {n: most_bytes // len(names) for n in names}, [], []
    for row in found.orderBy(order, text).select(text, lang).toLocalIterator():
        raw = row[0].encode("utf-8", "surrogatepass")
        if len(raw) <= left[row[1]]:
            left[row[1]] -= len(raw)
            texts.append(raw)
            langs.append(row[1])
    return texts, langs


def train(documents: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> dict | None:
    return fit(*training_rows(pick(documents, key, text, lang), lang, text, key, rows, most_bytes))


def predict(documents: DataFrame, model: dict | None, text: str = "text", into: str = "found") -> DataFrame:
    """Documents with a struct column ``into``: lang and score, the document's probability of that language."""
    spark = session_of(documents)
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # a few thousand weights

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for column in batches:
            texts = column.to_pylist()
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            readable = [i for i, t in enumerate(texts) if known and t and has_letter(t)]
            for a in range(0, len(readable), 500):
                part = readable[a : a + 500]
                shares = position_sums(known["p"], [texts[i].encode("utf-8", "surrogatepass") for i in part])
                best = shares.argmax(1)
                for i, k, s in zip(part, best, shares[np.arange(len(part)), best]):
                    langs[i], scores[i] = known["names"][k], min(1.0, float(s))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    own, (at,) = numbered(documents, text)
    return own.withColumn(into, run(F.col(at))).toDF(*documents.columns, into)


def held_out(key: str, mod: int, kept: int):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % mod == kept, F.lit(False))


def op2_langid(spark, sf_dir: str) -> DataFrame:
    documents = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang")
    documents = documents.withColumn("held_out", held_out("doc_id", 4, 2))
    model = train(documents.filter(~F.col("held_out")))
    out = predict(documents.select("doc_id", "text", "held_out"), model)
    return out.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
