"""Retrieval by indexes: binary codes with exact rescoring, postings in blocks."""

from pyspark.sql import functions as F

from tessera.cluster import Workspace
from tessera.operators import blockmax, bm25, quantised
from tessera.plans.search import BM25_SQL, vectors
from tessera.plans.tables import table
from tessera.registry import query

# Signs of components, then of sums with fixed signs, 64 to a long, the first in the lowest bit.
CODES_SQL = """
e AS (SELECT vec_id doc, list_transform(embedding, lambda x: x::DOUBLE) vec FROM embeddings WHERE len(embedding) > 0),
fixed AS (SELECT j, list(CASE WHEN ((h * h + 12345) % 2147483647 * ((h * h + 12345) % 2147483647) + i + 1) % 2147483647 * 2 > 2147483647 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY i) s
  FROM (SELECT i, j, ((i + 1) * 1103515245 + (j + 1) * 809050113) % 2147483647 h FROM range(64) a(i), range(1984) b(j)) GROUP BY j),
bits AS (SELECT doc, i - 1 AS p, vec[i] > 0 AS one FROM e, range(1, 65) r(i) UNION ALL SELECT doc, 64 + j, list_dot_product(vec, s) > 0 FROM e, fixed),
longs AS (SELECT doc, p // 64 AS w, sum(CASE WHEN one THEN 1::HUGEINT << (p % 64)::INT ELSE 0::HUGEINT END)::HUGEINT v FROM bits GROUP BY ALL),
codes AS (SELECT doc, list((CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END)::BIGINT ORDER BY w) code FROM longs GROUP BY doc)"""


def codes(spark, d):
    own, chunks = vectors(spark, d)
    return own, quantised.Codes(chunks.select("doc", "vec"), Workspace(spark).keep)


@query("dense_codes", f"WITH {CODES_SQL} SELECT doc, 64 AS size, code FROM codes")
def dense_codes(spark, d):
    return codes(spark, d)[1].codes


@query(
    "dense_quantised",
    f"""WITH {CODES_SQL}, asked AS (SELECT item_id "query", code qcode, vec qvec FROM benchmark JOIN codes ON doc = item_id JOIN e ON e.doc = item_id),
    far AS (SELECT "query", c.doc, list_sum(list_transform(list_zip(qcode, code), lambda z: bit_count(xor(z[1], z[2])))) distance FROM asked, codes c),
    near AS (SELECT *, row_number() OVER (PARTITION BY "query" ORDER BY distance, doc) n FROM far),
    scored AS (SELECT near."query", near.doc, round(list_dot_product(qvec, vec) / sqrt(list_dot_product(qvec, qvec) * list_dot_product(vec, vec)), 6) score FROM near JOIN asked USING ("query") JOIN e ON e.doc = near.doc WHERE n <= 40),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY "query" ORDER BY score DESC, doc)::INT rank FROM scored)
    SELECT "query", doc, score, rank FROM ranked WHERE rank <= 10""",
)
def dense_quantised(spark, d):
    own, index = codes(spark, d)
    return index.search(own, 10)


def blocks(spark, d):
    work = Workspace(spark)
    docs, own = bm25.Model().documents(table(spark, d, "documents"), "doc_id", "text", work.keep)
    return blockmax.Index.of(docs, own, lambda rows, tasks: work.bucketed(rows, tasks, blockmax.BLOCK, "token"))


@query("bm25_blocks", f'WITH {BM25_SQL} SELECT "query", doc, score, rank::INT rank FROM sparse WHERE rank <= 10')
def bm25_blocks(spark, d):
    return blocks(spark, d).search(bm25.Model().asked(table(spark, d, "benchmark"), "item_id", "text"), 10)


@query(
    "bm25_bounds",
    f"""WITH {BM25_SQL}, ds AS (SELECT doc, greatest(0, least(255, floor(8 * log2(1 + max(weight)))))::INT AS "level" FROM postings GROUP BY doc),
    b AS (SELECT token, "level", count(*) n, max(weight) bound FROM postings JOIN ds USING (doc) GROUP BY ALL)
    SELECT token, "level", n::BIGINT n, round(bound, 6) bound FROM b""",
)
def bm25_bounds(spark, d):
    """Postings and greatest weights by token and level, from the blocks of the index."""
    return blocks(spark, d).rows.groupBy("token", "level").agg(F.sum("n").alias("n"), F.round(F.max("bound"), 6).alias("bound"))
