"""Hierarchical summaries and sort keys."""

from pyspark.sql import functions as F

from tessera.cluster import Workspace
from tessera.operators import extracts, latent, ordering, summaries
from tessera.plans.search import WORDS
from tessera.plans.tables import table
from tessera.registry import query


def pages(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("n_name").alias("folder"), F.col("n_regionkey").cast("string").alias("top"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("text"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("key"), F.array("c_mktsegment").alias("entities"),
    )


SQL = """SELECT {g} AS {name}, {g} || '#{kind}' chunk_id, string_agg('**' || c_name || ':** ' || c_mktsegment, chr(10) || chr(10) ORDER BY c_custkey) AS content, list_sort(list_distinct(list(c_mktsegment))) api_entities,
    min(lpad(c_custkey::VARCHAR, 8, '0')) global_sort_key, '{kind}' chunk_type FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""


@query("folder_summaries", SQL.format(g="n_name", name="folder", kind="folder_summary"))
def folder_summaries(spark, d):
    return summaries.roll_up(pages(spark, d), F.col("folder"), "folder", "title", "text", "key", "entities", "folder_summary")


@query("top_summaries", SQL.format(g="n_regionkey::VARCHAR", name="top", kind="top_summary"))
def top_summaries(spark, d):
    return summaries.roll_up(pages(spark, d), F.col("top"), "top", "title", "text", "key", "entities", "top_summary")


@query("page_summaries", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[^.!?\n]+[.!?]?')[1:2], '') summary FROM documents WHERE text IS NOT NULL")
def page_summaries(spark, d):
    rows = table(spark, d, "documents").filter(F.col("text").isNotNull())
    return rows.select("doc_id", summaries.first_sentences(F.col("text")).alias("summary"))


# Sentences of each text with their first places, weights of slots in whole bits, scores by the centroid; the best two in text order.
EXTRACTS_SQL = rf"""WITH cut AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]?'), lambda s: trim(s)), lambda s: s <> '') ss FROM documents),
    every AS (SELECT doc_id, unnest(ss) s, unnest(range(len(ss))) i FROM cut), own AS (SELECT doc_id, s, min(i) i FROM every GROUP BY ALL),
    w AS (SELECT doc_id, i, unnest({WORDS.format(t='s')}) token FROM own), k AS (SELECT token, ('0x' || substr(md5(token), 1, 8))::BIGINT % 1048576 slot FROM (SELECT DISTINCT token FROM w)),
    c AS (SELECT doc_id, i, slot, count(*) n FROM w JOIN k USING (token) GROUP BY ALL), t AS (SELECT doc_id, slot, sum(n)::BIGINT total FROM c GROUP BY ALL),
    df AS (SELECT slot, length(bin((SELECT count(*) FROM documents) // count(*))) b FROM t GROUP BY 1),
    z AS (SELECT doc_id, i, sum(n * total * b * b)::BIGINT::DOUBLE product, sum(n * n * b * b)::BIGINT::DOUBLE size FROM c JOIN t USING (doc_id, slot) JOIN df USING (slot) GROUP BY ALL),
    ranked AS (SELECT doc_id, i, s, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(product * product / size, 0) DESC, i) r FROM own LEFT JOIN z USING (doc_id, i))
    SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(s, ' ' ORDER BY i), '') END "extract" FROM documents d LEFT JOIN ranked ON ranked.doc_id = d.doc_id AND r <= 2 GROUP BY d.doc_id, d.text"""


@query("page_extracts", EXTRACTS_SQL)
def page_extracts(spark, d):
    """N3."""
    rows = table(spark, d, "documents").select("doc_id", "text")
    return extracts.extracts(rows, "text").select("doc_id", "extract")


@query("latent_embeddings")
def latent_embeddings(spark, d):
    """N6; no SQL: held against an exact SVD in the tests."""
    return latent.embedded(table(spark, d, "documents"), "doc_id", "text", Workspace(spark).keep)


@query("latent_questions")
def latent_questions(spark, d):
    """The best sentences of every text as its questions, with vectors by the directions of the texts."""
    rows, keep = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text"), Workspace(spark).keep
    made = extracts.extracts(rows, "text", into="q").select("chunk_id", summaries.questions(F.split("q", r"(?<=[.!?]) ")).alias("hype_questions"))
    asked = keep(summaries.question_rows(made))
    return latent.learn(rows, "text", keep=keep).embed(asked, "chunk_id", "content")


@query(
    "hashed_embeddings",
    f"""WITH w AS (SELECT doc_id, {WORDS.format(t='text')} ws FROM documents), t AS (SELECT doc_id, unnest(ws) token FROM w), s AS (SELECT doc_id, (('0x' || substr(md5(token), 1, 8))::BIGINT % 64)::INT slot, count(*) n FROM t GROUP BY ALL),
    l AS (SELECT doc_id, sqrt(sum(n * n)::DOUBLE) norm, sum(n)::BIGINT tokens FROM s GROUP BY 1),
    g AS (SELECT l.doc_id, i, norm, coalesce(n, 0)::DOUBLE / norm x FROM l CROSS JOIN range(0, 64) r(i) LEFT JOIN s ON s.doc_id = l.doc_id AND s.slot = i)
    SELECT documents.doc_id, coalesce(list(x ORDER BY i) FILTER (i IS NOT NULL), list_transform(range(0, 64), lambda k: 0.0::DOUBLE)) embedding, coalesce(any_value(tokens), 0)::BIGINT tokens FROM documents LEFT JOIN g ON g.doc_id = documents.doc_id LEFT JOIN l ON l.doc_id = documents.doc_id GROUP BY 1""",
)
def hashed_embeddings(spark, d):
    """N6."""
    from tessera.operators.bm25 import tokens

    return summaries.hashed_embeddings(table(spark, d, "documents"), "doc_id", tokens(F.col("text")))


@query(
    "hype_question_rows",
    "SELECT 'c' || c_custkey || '#hype#' || i chunk_id, 'c' || c_custkey parent_chunk_id, c_mktsegment || ' ' || i AS content, 'hype_question' chunk_type FROM customer, range(0, 2) t(i)",
)
def hype_question_rows(spark, d):
    made = F.array(*[F.concat_ws(" ", "c_mktsegment", F.lit(str(i))) for i in range(2)], F.lit(" "))
    rows = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("chunk_id"), summaries.questions(made).alias("hype_questions"))
    return summaries.question_rows(rows)


@query(
    "sort_key_fallback",
    "SELECT 'p' || p_partkey || '.md' path, CASE WHEN p_partkey % 4 = 0 THEN lpad((p_partkey % 7)::VARCHAR, 2, '0') ELSE '99_p' || p_partkey || '.md' END sort_key FROM part",
)
def sort_key_fallback(spark, d):
    part = table(spark, d, "part")
    path = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    keys = part.filter("p_partkey % 4 = 0").select(path.alias("path"), F.lpad((F.col("p_partkey") % 7).cast("string"), 2, "0").alias("sort_key"))
    return ordering.with_fallback(part.select(F.concat(path, F.lit(".md")).alias("path")), keys)


@query(
    "sort_key_by_category",
    """SELECT p_type, p_partkey, CASE WHEN g < 10 THEN '0' ELSE '' END || g || '_00_' || CASE WHEN i < 10 THEN '0' ELSE '' END || i sort_key FROM (SELECT p_type, p_partkey, dense_rank() OVER (ORDER BY p_type) g, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 i FROM part)""",
)
def sort_key_by_category(spark, d):
    return ordering.by_category(table(spark, d, "part").select("p_type", "p_partkey"), "p_type", "p_partkey")


@query(
    "sort_key_by_prefix",
    "SELECT p_partkey, lpad((p_partkey % 12)::VARCHAR, 2, '0') || '_99_00' sort_key FROM part",
)
def sort_key_by_prefix(spark, d):
    path = F.concat((F.col("p_partkey") % 12).cast("string"), F.lit(".guide/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/1.index.md"))
    return table(spark, d, "part").select("p_partkey", ordering.by_prefix(path).alias("sort_key"))


@query("sort_key_by_appearance", "SELECT n_nationkey, '00_' || lpad((n_nationkey // 10)::VARCHAR, 2, '0') || '_' || lpad((n_nationkey % 10)::VARCHAR, 2, '0') sort_key FROM nation")
def sort_key_by_appearance(spark, d):
    return table(spark, d, "nation").select("n_nationkey", ordering.by_appearance(F.col("n_nationkey")).alias("sort_key"))
