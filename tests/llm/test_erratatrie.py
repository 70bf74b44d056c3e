import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import erratatrie as E


def words_of(rows, every, least_characters, least_count):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in run)
            if key is not None and (h := zlib.crc32(f"{key}:{run}".encode())) % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least_characters and k >= least_count}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def exact(rows, every=199, least_characters=6, least_count=5, times=5):
    n, out = words_of(rows, every, least_characters, least_count), {}
    for w in n:
        beside = sorted((-n[v], v) for v in n if near(w, v))
        form = beside[0][1] if beside and -beside[0][0] >= times * n[w] else None
        out[w] = (form, n[w], len(beside), n[form] if form else None)
    def root(w):
        return root(out[w][0]) if out[w][0] else w
    return sorted((w, form or "", root(w), n, k, m or 0) for w, (form, n, k, m) in out.items())


def found(spark, rows, columns="doc_id long, text string", **options):
    df = spark.createDataFrame(rows, columns).selectExpr("*", "1 AS word", "2 AS n", "3 AS node", "4 AS TEXT_")
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in E.variants(df, **options).collect())


@pytest.mark.parametrize("letters", ["ab", "abcé", "ÿaB"])
def test_against_all_pairs(spark, letters):
    rng = random.Random(letters)
    words = ["".join(rng.choices(letters, k=rng.randint(4, 9))) for _ in range(150)]
    rows = [(d, " ".join(rng.choice(words[: rng.randint(1, 150)]) for _ in range(40))) for d in range(60)] + [(None, words[0]), (7, None), (8, ""), (9, "aa-" * 900), (9, "aa-" * 900)]
    options = {"every": 7, "least_characters": 4, "least_count": 2, "times": 2}
    assert found(spark, rows, **options) == exact(rows, **options)
    assert found(spark, rows, large=5, **options) == exact(rows, **options)


def test_chains_and_long_words(spark):
    long = "q" * 3000
    rows = [(1, f"{'abcdef ' * 700}{'abcdeg ' * 100}{'abcdgg ' * 20}{'abcggg ' * 4}{(long + ' ') * 30}{(long[1:] + ' ') * 6}")]
    options = {"every": 10**9, "least_count": 4}
    assert found(spark, rows, **options) == exact(rows, **options)
    assert ("abcggg", "abcdgg", "abcdef", 4, 1, 20) in found(spark, rows, **options)


def test_edges(spark, documents, no_documents):
    assert {r.word: r.n for r in E.variants(documents, every=3, least_characters=4, least_count=1).collect()} == words_of([(r.doc_id, r.text) for r in documents.collect()], 3, 4, 1)
    assert E.variants(no_documents).collect() == []
