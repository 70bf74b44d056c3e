import random
from collections import Counter

from tessera.llm import suffixlevels as S

LENGTH, SPREAD = 40, 20


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = set()
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone.update(range(i, i + length))
        runs = sum(1 for i in gone if i - 1 not in gone)
        out.append((len(r), len(gone), runs, bytes(b for i, b in enumerate(r) if i not in gone)))
    return out


def texts():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    parts = [word(70), word(40), word(39), word(120)]
    out = [word(rng.randint(0, 60)) + rng.choice(parts) + word(rng.randint(0, 60)) for _ in range(60)]
    return out + [out[0], out[0], None, "", "ab" * 100, "x" * 39, "y" * 40, "z" * 41, word(30) + parts[3] + word(30) + parts[3]]


def check(spark, hot):
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string").selectExpr("*", "doc_id AS rid", "doc_id AS t1", "doc_id AS marks")
    out = S.remove_repeats(docs, length=LENGTH, spread=SPREAD, hot_segments=hot)
    assert out.columns == [*docs.columns, "found"]
    got = {r.doc_id: r.found for r in out.collect()}
    for i, want in enumerate(brute(rows, LENGTH)):
        f = got[i]
        assert (f.n_bytes, sum(s["len"] for s in f.spans), len(f.spans), bytes(f.kept)) == want, i


def test_against_brute_force(spark):
    check(spark, S.HOT_SEGMENTS)


def test_hot_keys_against_brute_force(spark):
    check(spark, 1)


def test_edges(spark, documents, no_documents):
    rows = S.remove_repeats(documents).collect()
    assert len(rows) == 8 and {r.found.n_bytes for r in rows if not r.text} == {0}
    assert next(r for r in rows if r.doc_id == 5).found.kept == b""
    assert S.remove_repeats(no_documents).count() == 0


def test_levels_merge():
    family = S.IndexFamily()
    for i in range(16):
        family.add([(bytes([i, j]), (i, j)) for j in range(4)])
    assert len(family.levels) == 1 and len(family.levels[0]) == 64 and not family.repeated
    family.add([(bytes([3, 2]), "new")])
    assert family.repeated == {(3, 2), "new"}
