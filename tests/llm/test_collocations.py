import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import collocations as C


def exact(rows, longest=3, least=10, share=50, most=2000):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and 100 * b >= share * a and inside(q) for q, b in candidates.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS n", "2 AS gram", "3 AS phrase", "4 AS LANG_")
    return sorted(tuple(r) for r in C.collocations(df, **options).collect())


def texts(seed, docs=120):
    rng = random.Random(seed)
    words = ["a", "B", "b", "ça", "The", "x1", "Ü", "of it", " "]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "?!"]
    return [(rng.choice(["en", "de", None, ""]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60)))) for _ in range(docs)] + [(None, None), ("en", ""), ("en", " ..\t")]


@pytest.mark.parametrize("options", [{}, {"longest": 4, "least": 3}, {"least": 2, "share": 90, "most": 5}, {"bits": 64, "chunk_bytes": 300, "bucket_bytes": 200}])
def test_against_brute_force(spark, options):
    rows = texts(str(options)) * 2
    own = {k: v for k, v in options.items() if k in ("longest", "least", "share", "most")}
    assert found(spark, rows, **options) == exact(rows, **own)


def test_the_filter_rules_out_and_keeps():
    import pyarrow as pa

    con, gram = C.duck(), pa.array([f"w{i}" for i in range(2000)])
    lang, bits = pa.array(["en"] * 2000), C.np.zeros(1 << 10, C.np.uint64)
    h = C.hashes(con, lang[:1000], gram[:1000]) % C.np.uint64(1 << 16)
    C.np.bitwise_or.at(bits, (h >> C.np.uint64(6)).astype(int), C.np.uint64(1) << (h & C.np.uint64(63)))
    allowed = C.Filter(bits).allows(con, lang, gram)
    assert allowed[:1000].all() and allowed[1000:].mean() < 0.1


def test_ranks_in_salted_parts_and_exact_arithmetic(spark):
    rows = spark.createDataFrame([("en", f"p {i}", 2, 10**14 + i % 3, 1, 10**14 + 1, 10**14 + 7, i // 7) for i in range(300)], "lang string, phrase string, length int, a long, k int, l long, r long, score long")
    got = [(r["rank"], r.phrase) for r in C.best(rows, 40).orderBy("rank").collect()]
    assert got == [(i + 1, r.phrase) for i, r in enumerate(sorted(rows.collect(), key=lambda r: (-r.score, -r.a, r.phrase))[:40])]
    counts = spark.createDataFrame([("en", "a b", 10**14 - 1, 2), ("en", "a", 10**14, 1), ("en", "b", 10**14 + 3, 1)], "lang string, gram string, n long, length int")
    assert C.scored(counts).first().score == 10**6 * (10**14 - 1) ** 2 // (10**14 * (10**14 + 3))


def test_edges(spark, no_documents):
    assert found(spark, []) == []
    assert found(spark, [("en", "a " * 9000), ("en", "a " * 9000)]) == exact([("en", "a " * 9000), ("en", "a " * 9000)])
