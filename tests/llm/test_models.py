import zlib

import numpy as np

from tessera.llm import langid as L
from tessera.llm import quality as Q


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in L.init(3, 4, rng).items()}
    codes, y = rng.integers(0, 256, (5, 6)).astype(np.uint8), rng.integers(0, 3, 6)

    def loss():
        share = L.softmax(L.forward({k: v.astype(np.float32) for k, v in p.items()}, codes, False)[0].astype(np.float64))
        return -np.log(share[:, y, np.arange(6)]).sum()

    own = {k: v.astype(np.float32) for k, v in p.items()}
    logits, tape = L.forward(own, codes, True)
    g = L.softmax(logits)
    g[:, y, np.arange(6)] -= 1
    found = L.backward(own, codes, g, tape)
    for name, at in (("u", (0, 2, 1)), ("u", (1, 9, 3)), ("b", (0, 1, 0)), ("o", (1, 2, 0)), ("c", (1, 0)), ("x", (0, 5, int(codes[2, 0])))):
        old, step = p[name][at], 2e-2
        p[name][at] = old + step
        up = loss()
        p[name][at] = old - step
        down = loss()
        p[name][at] = old
        assert abs((up - down) / (2 * step) - found[name][at]) < 0.03 * max(1, abs(found[name][at]))


def test_language_on_held_out_rows(spark, sf):
    rows = L.op2_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, documents, no_documents):
    model = L.fit([b"the cat and the hat", "le chat et la maison été".encode()] * 5, ["en", "fr"] * 5, steps=20)
    got = {(r.doc_id, r.text): r.found for r in L.predict(documents, model).collect()}
    assert got[(2, None)].lang == "und" and got[(3, "")].lang == "und" and got[(4, " \n\t ")].lang == "und"
    assert got[(None, "no id here")].lang in ("en", "fr")
    assert L.predict(no_documents, model).count() == 0
    assert L.fit([], []) is None and {r.found.lang for r in L.predict(documents, None).collect()} == {"und"}


def test_signs_that_are_no_letters(spark):
    model = L.fit([b"the cat", b"le chat"], ["en", "fr"], steps=5)
    docs = spark.createDataFrame([(1, "\u00bd \u00b2 \u2162"), (2, "\u00bd a")], "doc_id long, text string")
    assert {r.doc_id: r.found.lang == "und" for r in L.predict(docs, model).collect()} == {1: True, 2: False}


def test_every_language_gets_its_share_of_the_sample(spark):
    rows = [(i, "a" * 400, "aa") for i in range(40)] + [(100 + i, f"b{i}", f"z{i}") for i in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = L.training_rows(docs, "lang", "text", "doc_id", 300, 251 * 900)
    assert len(set(langs)) == 251 and langs.count("aa") == 2


def test_positions_cover_the_whole_text():
    model = L.fit([b"aaaa bbbb", b"cccc dddd"], ["x", "y"], steps=30)
    texts = [b"a" * 300 + b"c" * 40, b"c"]
    shares = L.position_sums(model["p"], texts, window=64, batch=3)
    assert np.allclose(shares.sum(1), 1, atol=1e-4)
    assert np.allclose(shares, L.position_sums(model["p"], texts, window=64), atol=1e-5)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    model = {"w0": 0.3, "w": rng.normal(size=Q.N_FEATURES), "v": rng.normal(size=(Q.N_FEATURES, Q.RANK)), "edges": np.tile(np.arange(1, Q.BINS), (len(Q.STATS), 1)).astype(float)}
    rows, ids, values = Q.inputs([b"some words and some more", b""], model["edges"])
    raw, _ = Q.sums(model, rows, ids, values, 2)
    for k in range(2):
        i, x = ids[rows == k], values[rows == k].astype(float)
        pairs = sum(model["v"][i[a]] @ model["v"][i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert abs(raw[k] - (0.3 + model["w"][i] @ x + pairs)) < 1e-3


def test_quality_on_held_out_rows(spark, sf):
    out = Q.op8_quality(spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.85
    for label in (0, 1):
        assert np.mean([r.predicted == label for r in rows if r.quality == label]) > 0.9
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_rare_label_is_learned():
    rng = np.random.default_rng(2)
    words = [f"w{i}".encode() for i in range(300)]

    def made(good, n):
        return [b" ".join(w + (b"" if good else b"%%") for w in rng.choice(words, 60)) for _ in range(n)]

    model = Q.fit(made(True, 60) + made(False, 4), np.array([1] * 60 + [0] * 4, np.float32))
    assert (Q.score_texts(model, made(False, 30)) < 0.5).mean() > 0.9 and (Q.score_texts(model, made(True, 30)) >= 0.5).mean() > 0.9
    only = Q.fit(made(True, 20), np.ones(20, np.float32))
    assert (Q.score_texts(only, made(True, 5)) > 0.5).all()


def test_sample_passes_over_what_does_not_fit(spark):
    docs = spark.createDataFrame([(1, "x" * 900), (2, "a b"), (3, "c d"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, quality int")
    texts, marks = Q.training_rows(docs, labels, "quality", "doc_id", "text", 10, 100)
    assert sorted(texts) == [b"", b"a b", b"c d"] and sorted(marks.tolist()) == [0, 0, 1]


def test_quality_edges(spark, documents, no_documents):
    texts = [b"good words in a row", b"bad%%% bad### $$$"] * 10
    model = Q.fit(texts, np.array([1, 0] * 10, np.float32))
    rows = Q.score(documents, model, into="quality").collect()
    assert len(rows) == 8 and all(0 <= r.quality <= 1 for r in rows)
    assert rows[0].quality == rows[1].quality
    assert Q.score(no_documents, model).count() == 0
    assert Q.fit([], np.zeros(0)) is None and set(Q.score_texts(None, [b"x"])) == {0.5}
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.train(documents, empty) is None
