import random
import re

import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.cluster import Workspace
from tessera.operators import bm25, firsts


def corpus(spark):
    rng, words = random.Random(11), ["a1", "b2", "é3", "中中", "Dd", *(f"x{i}{j}" for i in range(3) for j in range(3))]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), f"src{rng.randrange(3)}") for i in range(80)]
    docs += [(100 + i, "a1 b2 copies", "src1") for i in range(20)]  # ties of more documents than stay
    docs += [(7, docs[7][1], "src0"), (7, "b2 b2", "src0"), (8, docs[8][1], docs[8][2]), (8, docs[8][1], docs[8][2]), (None, "b2 other", "src1"), (None, "a1", None), (50, None, "src1"), (51, "", "src1"), (52, "the", "src2"), (53, "a1 é3", None)]
    return spark.createDataFrame(docs, "doc long, text string, source string").repartition(3)


def queries(spark):
    rows = [(0, "a1 b2 a1"), (1, "b2 copies a1"), (2, "x00 x11 x22 中中 dd é3 a1 b2"), (3, "unseen words"), (4, None), (5, "the of"), (6, "b2"), (6, "b2 é3"), (None, "a1")]
    return spark.createDataFrame(rows, "id long, text string")


@pytest.mark.parametrize("most, most_asked, most_queries", [(firsts.WORK, firsts.ASKED, firsts.QUERIES), (1, 200_000, 2000), (40, 3, 2000), (200, 200_000, 2)])
def test_firsts_against_all_scores(spark, most, most_asked, most_queries):
    """As by summing all postings: keys of several rows, nulls, ties, one row at a time, queries in blocks."""
    docs, model = corpus(spark), bm25.Model()
    asked = model.asked(queries(spark), "id", "text").distinct()
    wanted = F.concat(F.lit("src"), (F.col("query") % 3).cast("string"))
    scores = bm25.Model().fit(docs, "doc", "text").postings.join(asked, "token").groupBy("query", "doc").agg(F.round(F.sum("weight"), 6).alias("score"))
    sources = docs.select("doc", "source")
    inside = scores.join(sources, "doc").filter((F.col("source") == wanted) & (F.col("score") > 0.4)).select("query", "doc", "score")
    got = firsts.firsts(model, docs, "doc", "text", asked, 4, Workspace(spark).keep, F.col("source"), wanted, 0.4, most, most_asked, most_queries)
    for found, all_of in zip(got, (scores, inside)):
        told = [sorted(map(tuple, rows.select("query", "rank", "doc", "score").collect()), key=repr) for rows in (found, bm25.top(all_of, 4))]
        assert told[0] == told[1] and len(told[0]) > 10


def test_firsts_without_scope_or_rows(spark):
    docs, model = corpus(spark), bm25.Model()
    asked = model.asked(queries(spark), "id", "text")
    whole, scoped = firsts.firsts(model, docs, "doc", "text", asked, 2, Workspace(spark).keep)
    assert whole.count() == 10 and scoped.count() == 0
    for rows, own in ((docs.limit(0), asked), (docs, asked.limit(0)), (docs.withColumn("text", F.lit(None).cast("string")), asked)):
        assert [x.count() for x in firsts.firsts(model, rows, "doc", "text", own, 2, Workspace(spark).keep, F.col("source"))] == [0, 0]


def test_scores_are_not_shuffled(spark, sf):
    """F2: nearly every pair of query and document is a score; they are made in the documents' rows."""
    rows = registry.queries()["search_scope_fallback"](spark, sf)
    whole = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in whole and not re.findall(r"hashpartitioning\([^)]*doc#", whole)
    assert "regexp_extract_all" not in whole  # no text is split again when hits are read
