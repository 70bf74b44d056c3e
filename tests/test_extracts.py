"""Extracts by centroids against a plain computation, and odd rows."""

import hashlib
import re

from tessera.operators import extracts
from tessera.operators.bm25 import STOP_WORDS


def split(text):
    found = [s.strip(" ") for s in re.findall(r"[^.!?\n]+[.!?]?", text)]
    return list(dict.fromkeys(s for s in found if s))


def tokens(s):
    return [w for w in re.findall(r"\w{2,}", s.lower()) if w not in STOP_WORDS]


def plain(docs, count, slots=1 << 20):
    def words(s):
        return [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % slots for w in tokens(s)]

    held = [{w for s in split(t or "") for w in words(s)} for t in docs]
    df = {w: sum(w in h for h in held) for h in held for w in h}
    out = []
    for t in docs:
        if t is None:
            out.append(None)
            continue
        own = split(t)
        total = [w for s in own for w in words(s)]
        scores = []
        for i, s in enumerate(own):
            ws = words(s)
            bits = {w: len(bin(len(docs) // df[w])) - 2 for w in ws}
            size = sum(ws.count(w) ** 2 * bits[w] ** 2 for w in bits)
            product = sum(ws.count(w) * total.count(w) * bits[w] ** 2 for w in bits)
            scores.append((-(float(product) * float(product) / size) if size else 0.0, i))
        out.append(" ".join(own[i] for i in sorted(i for _, i in sorted(scores)[:count])))
    return out


def test_against_plain_computation(spark, sf):
    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows = spark.createDataFrame(list(enumerate(docs)), "k int, text string")
    for count, slots in ((1, 1 << 20), (2, 1 << 20), (3, 64)):
        got = {r.k: r.extract for r in extracts.extracts(rows, "text", count, slots=slots).collect()}
        assert got == dict(enumerate(plain(docs, count, slots)))


def test_odd_rows(spark):
    rows = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (3, " . \n", 0), (4, "?? !! ..", 0), (5, "Same line.\nSame line.\nOther words.", 0), (None, "No key at all. None.", 0), (6, "one two. three four.", 0), (6, "one two. three four.", 0), (7, "x" * 300_000 + ". end", 0)],
        "k int, text string, TEXT_2 int",
    ).withColumnRenamed("TEXT_2", "key")
    found = extracts.extracts(rows, "text", 2)
    assert found.columns == ["k", "text", "key", "extract"]
    got = {r.k: r.extract for r in found.collect()}
    assert got[1] is None and got[2] == "" and got[3] == "." and got[4] == " ".join(split("?? !! ..")) == "! ."
    assert got[5] == "Same line. Other words." and got[None] == "No key at all. None." and got[6] == "one two. three four." and len(got[7]) == 300_005
    assert found.count() == 9 and extracts.extracts(rows.limit(0), "text").count() == 0


def test_prefixes(spark):
    rows = spark.createDataFrame([("a", "First apples. Apples and apples grow.", "section", None), ("b", "Told already.", "section", "old"), ("c", "![x](y)", "image", None)], "chunk_id string, content string, chunk_type string, contextual_prefix string")
    got = {r.chunk_id: r.contextual_prefix for r in extracts.prefixes(rows).collect()}
    assert got == {"a": plain(["First apples. Apples and apples grow.", "Told already.", "![x](y)"], 1)[0], "b": "old", "c": None}
