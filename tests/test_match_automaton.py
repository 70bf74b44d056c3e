"""Containment by an automaton of phrases."""

import random

from tessera.operators import match


def test_against_every_phrase():
    rng = random.Random(2)
    phrases = sorted({"".join(rng.choices("abé ", k=rng.randint(1, 5))) for _ in range(60)})
    automaton = match.Automaton(phrases)
    for _ in range(300):
        text = "".join(rng.choices("abéc ", k=rng.randint(0, 40)))
        assert {phrases[i] for i in automaton.found(text)} == {p for p in phrases if p in text}


def test_shards_and_other_columns(spark):
    names = spark.createDataFrame([("useFetch", 1), ("fetch", 2), ("FETCH", 3), ("etc", 4), ("", 5), (None, 6)], "name string, n int")
    asked = spark.createDataFrame([(1, "use `useFetch` now", "x"), (1, "use `useFetch` now", "x"), (2, None, "y"), (3, "", "z"), (4, "nothing", "w")], "query long, text string, other string")
    want = sorted(map(tuple, match.contained(asked, names, "name").select("query", "name", "other").collect()))
    assert want == [(1, "FETCH", "x")] * 2 + [(1, "etc", "x")] * 2 + [(1, "fetch", "x")] * 2 + [(1, "useFetch", "x")] * 2
    assert sorted(map(tuple, match.contained(asked, names, "name", most_bytes=1).select("query", "name", "other").collect())) == want
    assert match.contained(asked, names.limit(0), "name").count() == 0
    assert match.contained(asked.limit(0), names, "name").count() == 0
