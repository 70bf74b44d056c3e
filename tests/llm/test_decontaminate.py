import random

from pyspark.sql import functions as F

from tessera.llm import decontaminate as D
from tessera.llm.common import words_of


def brute(text, items, window=13):
    words, hit, who = words_of(text), set(), set()
    for item, t in items:
        own = words_of(t)
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if own else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit.update(range(j, j + n))
                    if item is not None:
                        who.add(str(item))
    return len(words), len(hit), sorted(who)


def rows_of(found):
    return [(r.found.n_words, sum(s["len"] for s in r.found.spans), sorted(r.found["items"])) for r in found.orderBy("k").collect()]


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["a", "B", "c", "d"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(40)] + [None, "", "é-x 1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 13, 15, 20])))) for i in range(6)] + [(7, texts[3]), (7, "é"), (None, "x"), (9, None)]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    want = [brute(t, items) for t in texts]
    assert rows_of(D.search(docs, bench)) == want
    assert rows_of(D.search(docs, bench, shard_bytes=20)) == want


def test_edges(spark, documents, no_documents):
    bench = spark.createDataFrame([], "item_id int, text string")
    out = D.search(documents, bench)
    assert out.count() == 8 and out.filter(D.contaminated()).count() == 0
    assert D.search(no_documents, bench).count() == 0


def test_contamination_rule(spark):
    item = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(1, item + " x" * 247), (2, item + " x" * 248)], "k int, text string")
    out = D.search(docs, spark.createDataFrame([(1, item)], "item_id int, text string"))
    assert [r.c for r in out.withColumn("c", D.contaminated()).orderBy("k").collect()] == [True, False]
    assert out.select(D.n_hit().alias("n")).first().n == 13
    assert out.select(F.size("found.items")).first()[0] == 1
