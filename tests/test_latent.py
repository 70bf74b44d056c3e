"""Directions of a corpus against an exact SVD, neighbours of near copies, odd rows."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import latent
from tessera.operators.bm25 import STOP_WORDS

SMALL = 512


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").cache()


def exact(spark, rows, slots):
    """The whole matrix at once, its tokens split here."""
    texts = [r.text or "" for r in rows.orderBy("doc_id").collect()]
    own = [[w for w in re.findall(r"\w{2,}", t.lower()) if w not in STOP_WORDS] for t in texts]
    names = sorted({w for ws in own for w in ws})
    hashed = spark.createDataFrame([(w,) for w in names], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(slots)).alias("s"))
    place = {r.w: r.s for r in hashed.collect()}
    counts = np.zeros((len(texts), slots))
    for i, ws in enumerate(own):
        for w in ws:
            counts[i, place[w]] += 1
    df = (counts > 0).sum(0)
    a = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * np.where(df > 0, np.log(1 + len(texts) / np.maximum(df, 1)), 0)
    norms = np.linalg.norm(a, axis=1, keepdims=True)
    return np.divide(a, norms, out=np.zeros_like(a), where=norms > 0)


def test_against_exact_svd(spark, corpus):
    a = exact(spark, corpus, SMALL)
    _, values, v = np.linalg.svd(a, full_matrices=False)
    few = latent.learn(corpus, "text", SMALL, 8)  # the greatest values come first, all are within a few percent
    assert np.allclose(few.values[:3], values[:3], rtol=1e-3) and np.allclose(few.values, values[:8], rtol=0.05)
    learned = latent.learn(corpus, "text", SMALL, 8, passes=30)
    assert np.allclose(learned.values, values[:8], rtol=1e-3)
    # Directions whose value stands apart from its neighbours' are the same but for the sign.
    gaps = np.minimum(np.append(np.inf, values[:7] - values[1:8]), values[:8] - values[1:9]) / values[:8]
    apart = np.flatnonzero(gaps > 0.1)
    assert len(apart) and all(abs(learned.basis[:, i] @ v[i]) > 0.99 for i in apart)
    # Vectors are projections on the learned directions.
    found = np.array([r.embedding for r in learned.embed(corpus, "doc_id", "text").orderBy("doc_id").collect()])
    plain = a @ learned.basis
    norms = np.linalg.norm(plain, axis=1, keepdims=True)
    assert np.allclose(found, np.divide(plain, norms, out=np.zeros_like(plain), where=norms > 1e-12), atol=1e-8)


def test_near_copies_are_neighbours(spark, corpus):
    texts = {r.doc_id: r.text for r in corpus.filter("length(text) > 600").orderBy("doc_id").collect()}
    learned = latent.learn(corpus, "text")
    changed = {k: " ".join(w for i, w in enumerate(t.split()) if i % 10) for k, t in texts.items()}
    rows = spark.createDataFrame([*texts.items(), *((-1 - k, t) for k, t in changed.items())], "doc_id long, text string")
    found = {r.doc_id: np.array(r.embedding) for r in learned.embed(rows, "doc_id", "text").collect()}
    keys = sorted(texts)
    base = np.array([found[k] for k in keys])
    # The best rows include the changed text's own (exact copies tie with it).
    hits = sum(float(found[k] @ found[-1 - k]) >= (base @ found[-1 - k]).max() - 0.02 for k in keys)
    assert hits >= 0.95 * len(keys)


def test_questions_have_vectors_by_the_same_directions(spark, corpus):
    from tessera.operators import summaries

    learned = latent.learn(corpus, "text", SMALL, 8)
    chunks = corpus.filter("text is not null").select(F.col("doc_id").cast("string").alias("chunk_id"), F.array(F.substring("text", 1, 200), F.lit(" ")).alias("q"))
    rows = summaries.question_rows(chunks.select("chunk_id", summaries.questions(F.col("q")).alias("hype_questions")))
    found = learned.embed(rows, "chunk_id", "content").collect()
    assert len(found) == rows.count() and all(len(r.embedding) == 8 for r in found)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "apple pie", "c"), (3, "apple pie", "c"), (None, "apple cake", "d"), (4, "!", "e"), (5, "word " * 200_000, "f")], "k int, text string, slots string")
    learned = latent.learn(rows, "text", 64, 3)
    found = learned.embed(rows, "k", "text")
    got = [(r.k, np.linalg.norm(r.embedding)) for r in found.collect()]
    assert found.columns == ["k", "embedding"] and len(got) == 7
    assert all(abs(n - (0 if k in (1, 2, 4) else 1)) < 1e-6 for k, n in got)
    empty = latent.learn(rows.limit(0), "text", 64, 3)
    assert not empty.basis.any() and all(not any(r.embedding) for r in empty.embed(rows, "k", "text").collect())


def plain_product(lists, weights, q):
    """A' (A q), a product for every token, as it was made before."""
    size = len(weights)
    places, counts = np.unique(np.repeat(np.arange(len(lists)) * size, [len(x) for x in lists]) + np.concatenate(lists), return_counts=True)
    row, slot = np.divmod(places, size)
    value = (1 + np.log(counts)) * weights[slot]
    norms = np.sqrt(np.bincount(row, value * value, len(lists)))[row]
    value = np.divide(value, norms, out=np.zeros_like(value), where=norms > 0)
    y, total = np.zeros((len(lists), q.shape[1])), np.zeros_like(q)
    if len(row):
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        y[row[begins]] = np.add.reduceat(value[:, None] * q[slot], begins)
        order = np.argsort(slot, kind="stable")
        begins = np.flatnonzero(np.diff(slot[order], prepend=-1))
        total[slot[order[begins]]] += np.add.reduceat(value[order, None] * y[row[order]], begins)
    return total


def own_product(lists, weights, q):
    part, total = latent.Part(lists, weights), np.zeros_like(q)
    part.add_back(part.times(q), total)
    return total


def test_products_take_a_fraction_of_the_time():
    """texts of one token, of none, of many and mixed; and far less work than a product for every token."""
    rng = np.random.default_rng(0)
    weights, q = rng.random(latent.SLOTS) + 0.1, rng.standard_normal((latent.SLOTS, 40))
    weights[:50] = 0
    text = lambda n: np.minimum(rng.pareto(0.8, n) * 20, latent.SLOTS - 1).astype(np.int64)
    usual = [text(n) for n in rng.integers(20, 800, 80)]
    for lists in ([text(1) for _ in range(200)], [text(0)], [text(0)] * 130, [text(50_000), text(0), text(3)], [text(n % 3) for n in range(64)], usual):
        assert np.allclose(own_product(lists, weights, q), plain_product(lists, weights, q), atol=1e-12)

    def least(run):
        took = []
        for _ in range(5):
            start = time.perf_counter()
            run(usual, weights, q)
            took.append(time.perf_counter() - start)
        return min(took)

    assert least(own_product) < 0.6 * least(plain_product)


def test_texts_are_split_once(spark, sf, corpus):
    """vectors of the texts learned from are made of the kept slots."""
    from tessera import registry

    found = registry.queries()["latent_embeddings"](spark, sf)
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = latent.learn(corpus, "text").embed(corpus, "doc_id", "text").orderBy("doc_id").collect()
    got = found.orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    assert np.allclose(np.array([r.embedding for r in got]), np.array([r.embedding for r in want]), atol=1e-6)
