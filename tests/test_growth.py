"""Steps whose work must not grow faster than their tables: what is broadcast, shuffled, made anew or left in one task."""

import random

import pytest
from pyspark.sql import functions as F

from tessera import cluster, registry
from tessera.functions import text as T
from tessera.operators import blockmax, bm25, extracts, match


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_queries_are_never_broadcast(spark, sf):
    """pairs of queries and names are as many as queries, whatever size Spark projects from their file."""
    assert "BuildRight" in plan(registry.queries()["match_guarded"](spark, sf))
    assert "BuildLeft" not in plan(registry.queries()["match_guarded"](spark, sf))


def test_small_files_are_dealt(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    dealt = cluster.dealt(one, "id")
    assert dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > one.rdd.getNumPartitions()
    assert sorted(r.id for r in dealt.collect()) == list(range(1000))
    assert cluster.dealt(dealt, "id") is dealt


QUERIES = [(1, "use Fetch and abort here"), (1, "abort"), (2, "the abort signal"), (3, "none"), (4, None), (5, "use fetchdata now"), (6, "fetchdatas abort"), (7, "fetchdxta abort")]
NAMES = [("fetch",), ("useFetch",), ("abort",), ("fetchdata",), ("AbortSignal",), ("fetch",)]
SYNONYMS = [("abort", ["abort", "AbortSignal", "stop", "stop"]), ("ABORT", ["halt", None]), ("signal", ["stop", "sign"]), ("", ["empty"]), ("unseen", ["x"])]


def tables(spark):
    return spark.createDataFrame(QUERIES, "query long, text string"), spark.createDataFrame(NAMES, "name string"), spark.createDataFrame(SYNONYMS, "alias string, names array<string>")


def test_names_of_synonyms_are_not_shuffled(spark):
    """each pair once, without a shuffle by query and name."""
    queries, _, synonyms = tables(spark)
    found = match.synonym(queries, synonyms)
    want = {(q, n) for q, t in QUERIES for a, names in SYNONYMS if a and a.lower() in (t or "").lower() for n in names}
    got = list(map(tuple, found.collect()))
    assert len(got) == len(want) and set(got) == want
    assert "name" not in "".join(line for line in plan(found).splitlines() if "Exchange hashpartitioning" in line)


def test_priority_against_methods(spark, monkeypatch):
    queries, names, synonyms = tables(spark)
    claims: dict = {}
    for source, rows in (("exact", match.exact(queries, names)), ("bigram", match.bigram(queries, names)), ("synonym", match.synonym(queries, synonyms))):
        for r in rows.collect():
            claims.setdefault((r.query, r.name), source)
    taken = spark.createDataFrame([k for k in claims], "query long, name string")
    for r in match.fuzzy(queries, names, taken).collect():
        claims.setdefault((r.query, r.name), "fuzzy")
    got = sorted(map(tuple, match.match(queries, names, synonyms).collect()), key=repr)
    assert got == sorted(((*k, v) for k, v in claims.items()), key=repr)
    assert {"exact", "bigram", "synonym", "fuzzy"} == set(claims.values())
    monkeypatch.setattr(match, "BROADCAST_NAMES", 0)
    monkeypatch.setattr(match, "BROADCAST_SETS", 0)
    assert sorted(map(tuple, match.match(queries, names, synonyms).collect()), key=repr) == got


def test_bigrams_meet_names_before_a_shuffle(spark, sf):
    """pairs that are no name aren't shuffled."""
    lines = plan(registry.queries()["match_bigram"](spark, sf)).splitlines()
    met = next((i for i, line in enumerate(lines) if "LeftSemi" in line), 0)
    assert "BroadcastHashJoin" in lines[met] and any("HashAggregate(keys=[low" in line for line in lines[:met])


def test_tokens_are_counted_as_before(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab9_é中\U0001f600 \u0085 \t\n\x0b\f\r.,-²", k=rng.randint(0, 30))) for _ in range(400)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    before = F.size(F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"), F.lit(0)))
    assert rows.filter(T.token_count(F.col("t")) != before).count() == 0


def test_results_make_paths_once(spark, sf):
    """A text's paths are a column before they are used."""
    whole = registry.queries()["evaluation_results"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert whole.count("(?im)^source") == 1


@pytest.mark.parametrize("name", ["markdown_chunks", "markdown_subsections", "section_styles", "image_chunks", "markdown_headings"])
def test_files_are_walked_after_they_are_dealt(spark, sf, name):
    """Below the shuffle that deals the rows of a small file stands no walk over their lines."""
    parts = plan(registry.queries()[name](spark, sf)).split("REPARTITION_BY_NUM")
    assert len(parts) > 1
    for below in parts[1:]:
        scanned = below[: below.index("ReadSchema")]
        assert "FileScan" in scanned and "aggregate(" not in scanned and "split(" not in scanned


def test_texts_are_split_once(spark, sf):
    """no filter on the words of a text, which would split it a second time."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = bm25.Model().fit(docs, "doc_id", "text").postings._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in whole.splitlines() if "Filter" in line and "size(" in line]
    made = plan(extracts.extracts(docs, "text"))
    assert made.count("[^.!?") == 1


@pytest.mark.parametrize("most", [200_000, 5, 0])
def test_documents_hold_their_postings(spark, monkeypatch, most):
    """weighed in their rows as by joins of single postings; with and without tokens that aren't broadcast, docs with several texts, none or no words."""
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["a1", "b2", "é3", "中中", "Dd", *(f"x{i}{j}" for j in range(3))]) for _ in range(rng.randint(0, 30)))) for i in range(40)]
    docs += [(7, docs[7][1]), (7, "b2 b2"), (8, "new"), (None, "b2 other"), (None, "a1"), (50, None), (51, ""), (52, "the")]
    corpus = spark.createDataFrame(docs, "doc long, text string").repartition(3)
    work = cluster.Workspace(spark)
    monkeypatch.setattr(bm25, "BROADCAST_TOKENS", most)
    rows, own = bm25.Model().documents(corpus, "doc", "text", work.keep)
    told = lambda rows: sorted(((r.doc, r.token, round(r.weight, 9)) for r in rows.collect()), key=repr)
    model = bm25.Model().fit(corpus, "doc", "text")
    assert told(rows.select("doc", F.inline(own))) == told(model.postings)
    assert rows.count() == model.postings.select("doc").distinct().count()
    monkeypatch.setattr(blockmax, "PER_TASK", 3)
    index = blockmax.Index.of(rows, own, lambda rows, tasks: work.bucketed(rows, tasks, blockmax.BLOCK, "token"))
    assert told(index.rows.select("token", F.inline("postings"))) == told(model.postings)
    queries = spark.createDataFrame([(1, "a1 x30"), (2, "é3 b2 dd"), (3, "none")], "q long, t string")
    found = index.search(model.asked(queries, "q", "t"), 5)
    want = bm25.top(model.scores(queries, "q", "t"), 5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    work.close()


def test_blocks_are_read_where_they_lie(spark, sf):
    """F2: scores and bounds are made without a shuffle of postings, blocks or documents; only a query's first of each task are sent."""
    lines = [line for line in plan(registry.queries()["bm25_blocks"](spark, sf)).splitlines() if "Exchange hashpartitioning" in line]
    assert lines and not [line for line in lines if "doc#" in line or "block#" in line or "token#" in line]
