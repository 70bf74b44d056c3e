"""Retrieval: sparse, dense, hybrid, filtered; reranking and reconstruction."""

from pyspark.sql import functions as F

from tessera.cluster import Workspace
from tessera.operators import bm25, firsts, reconstruct, retrieval
from tessera.plans.tables import table
from tessera.registry import query

WORDS = r"list_filter(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({stop}))".replace("{stop}", ", ".join(f"'{w}'" for w in bm25.STOP_WORDS))
BM25_SQL = f"""
w AS (SELECT doc_id doc, {WORDS.format(t='text')} ws FROM documents),
size AS (SELECT count(*) n, avg(len(ws)) avgdl FROM w),
tf AS (SELECT doc, dl, token, count(*) tf FROM (SELECT doc, len(ws) dl, unnest(ws) token FROM w) GROUP BY ALL),
df AS (SELECT token, count(*) df FROM tf GROUP BY token),
postings AS (SELECT doc, token, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) weight FROM tf JOIN df USING (token), size),
qt AS (SELECT DISTINCT item_id "query", unnest({WORDS.format(t='text')}) token FROM benchmark),
scores AS (SELECT "query", doc, round(sum(weight), 6) score FROM postings JOIN qt USING (token) GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY "query" ORDER BY score DESC, doc) rank FROM scores)"""
DENSE_SQL = """
qv AS (SELECT item_id "query", embedding::DOUBLE[] qvec FROM benchmark JOIN embeddings ON vec_id = item_id),
cv AS (SELECT vec_id doc, embedding::DOUBLE[] vec, label FROM embeddings {where}),
dscores AS (SELECT "query", doc, round(list_sum(list_transform(list_zip(qvec, vec), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(qvec, lambda x: x * x)) * list_sum(list_transform(vec, lambda x: x * x))), 6) score FROM qv, cv),
dense AS (SELECT *, row_number() OVER (PARTITION BY "query" ORDER BY score DESC, doc) rank FROM dscores)"""


def model(spark, d):
    return bm25.Model().fit(table(spark, d, "documents"), "doc_id", "text")


def sparse_leg(spark, d, limit):
    return bm25.top(model(spark, d).scores(table(spark, d, "benchmark"), "item_id", "text"), limit)


def vectors(spark, d):
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec"), "label")
    own = table(spark, d, "benchmark").select(F.col("item_id").alias("query")).join(chunks.select(F.col("doc").alias("query"), F.col("vec").alias("qvec")), "query")
    return own, chunks


@query("bm25_vocabulary", f"WITH {BM25_SQL} SELECT token, df FROM df")
def bm25_vocabulary(spark, d):
    return model(spark, d).vocabulary


@query("bm25_query_vector", f'WITH {BM25_SQL} SELECT "query", token, 1.0::DOUBLE weight FROM qt WHERE token IN (SELECT token FROM df)')
def bm25_query_vector(spark, d):
    return model(spark, d).query_vector(table(spark, d, "benchmark"), "item_id", "text")


@query("bm25_search", f'WITH {BM25_SQL} SELECT "query", doc, score, rank::INT rank FROM sparse WHERE rank <= 10')
def bm25_search(spark, d):
    return sparse_leg(spark, d, 10)


@query("dense_search", f'WITH {DENSE_SQL.format(where="")} SELECT "query", doc, score, rank::INT rank FROM dense WHERE rank <= 10')
def dense_search(spark, d):
    return retrieval.dense(*vectors(spark, d), 10)


@query("dense_search_filtered", f'WITH {DENSE_SQL.format(where="WHERE label = 3")} SELECT "query", doc, score, rank::INT rank FROM dense WHERE rank <= 10')
def dense_search_filtered(spark, d):
    own, chunks = vectors(spark, d)
    return retrieval.dense(own, chunks, 10, F.col("label") == 3)


FUSED_SQL = f"""WITH {BM25_SQL}, {DENSE_SQL.format(where='')},
legs AS (SELECT "query", doc, rank FROM sparse WHERE rank <= 50 UNION ALL SELECT "query", doc, rank FROM dense WHERE rank <= 50),
parts AS (SELECT "query", doc, round(sum(1.0::DOUBLE / (2 + rank - 1)), 6) score FROM legs GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY "query" ORDER BY score DESC, doc) rank FROM parts)"""


def hybrid(spark, d, limit=10):
    return retrieval.fuse([sparse_leg(spark, d, 50), retrieval.dense(*vectors(spark, d), 50)], limit)


@query("hybrid_search", FUSED_SQL + ' SELECT "query", doc, score, rank::INT rank FROM fused WHERE rank <= 10')
def hybrid_search(spark, d):
    return hybrid(spark, d)


@query(
    "search_scope_fallback",
    f"""WITH {BM25_SQL}, scoped AS (SELECT s."query", s.doc, s.score, row_number() OVER (PARTITION BY s."query" ORDER BY s.score DESC, s.doc) rank FROM scores s JOIN documents ON doc = doc_id WHERE source = 'src' || (s."query" % 20) AND s.score > 12),
    near AS (SELECT * FROM scoped WHERE rank <= 5), whole AS (SELECT * FROM sparse WHERE rank <= 5)
    SELECT "query", doc, score, rank::INT rank FROM near UNION ALL SELECT "query", doc, score, rank::INT FROM whole WHERE "query" NOT IN (SELECT "query" FROM near)""",
)
def search_scope_fallback(spark, d):
    bm = bm25.Model()
    asked = bm.asked(table(spark, d, "benchmark"), "item_id", "text")
    wanted = F.concat(F.lit("src"), (F.col("query") % 20).cast("string"))
    whole, scoped = firsts.firsts(bm, table(spark, d, "documents"), "doc_id", "text", asked, 5, Workspace(spark).keep, F.col("source"), wanted, 12)
    return retrieval.with_fallback(scoped, whole)


@query(
    "hype_resolution",
    """WITH h AS (SELECT user_id "query", CASE WHEN event_type = 'click' THEN nullif(CASE WHEN event_id % 5 = 0 THEN '' ELSE 'c' || (event_id % 97) END, '') ELSE 'c' || (event_id % 211) END chunk_id, value score FROM events)
    SELECT "query", chunk_id, max(score) score FROM h WHERE chunk_id IN (SELECT 'c' || doc_id FROM documents) GROUP BY ALL""",
)
def hype_resolution(spark, d):
    def chunk(n):
        return F.concat(F.lit("c"), (F.col("event_id") % n).cast("string"))

    question = F.col("event_type") == "click"
    hits = table(spark, d, "events").select(
        F.col("user_id").alias("query"), chunk(211).alias("chunk_id"), F.col("value").alias("score"), F.when(question, "hype_question").otherwise("section").alias("chunk_type"),
        F.when(F.col("event_id") % 5 == 0, "").otherwise(chunk(97)).alias("parent_chunk_id"),
    )
    return retrieval.resolve_questions(hits, table(spark, d, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id")))


@query("get_by_ids", "SELECT doc_id, source, lang FROM documents WHERE doc_id IN (SELECT item_id * 3 FROM benchmark)")
def get_by_ids(spark, d):
    wanted = table(spark, d, "benchmark").select((F.col("item_id") * 3).alias("doc_id"))
    return retrieval.by_ids(table(spark, d, "documents").select("doc_id", "source", "lang"), wanted, "doc_id")


@query("get_by_paths", "SELECT doc_id, source FROM documents WHERE source IN ('src3', 'src5') AND lang IN ('en', 'de') ORDER BY source, doc_id LIMIT 100")
def get_by_paths(spark, d):
    wanted = spark.createDataFrame([("src3",), ("src5",)], "source string")
    return retrieval.by_paths(table(spark, d, "documents").select("doc_id", "source", "lang"), wanted, "source", ["source", "doc_id"], 100, ["en", "de"], "lang").select("doc_id", "source")


@query(
    "rerank",
    FUSED_SQL
    + """, r AS (SELECT f."query", f.doc, round(len(list_intersect(string_split(lower(b.text), ' '), string_split(lower(d.text), ' '))) * 2.0::DOUBLE / len(list_distinct(string_split(lower(b.text), ' '))) - 1, 6) score
    FROM fused f JOIN benchmark b ON b.item_id = f."query" JOIN documents d ON d.doc_id = f.doc WHERE rank <= 10)
    SELECT "query", doc, score, row_number() OVER (PARTITION BY "query" ORDER BY score DESC, doc)::INT rank FROM r WHERE score >= -0.5""",
)
def rerank(spark, d):
    hits = hybrid(spark, d).drop("rank")
    hits = hits.join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.split(F.lower("text"), " ").alias("dw")), "doc")
    hits = hits.join(table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.split(F.lower("text"), " ").alias("qw")), "query")
    share = F.round(F.size(F.array_intersect("qw", "dw")) * F.lit(2.0) / F.size(F.array_distinct("qw")) - 1, 6)
    return retrieval.rerank(hits, share).select("query", "doc", "score", "rank")


READ_SQL = """hits AS (SELECT c_nationkey "query", c_custkey chunk_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) rank,
  CASE WHEN c_custkey % 17 = 0 THEN 'folder_summary' WHEN c_custkey % 19 = 0 THEN 'page_summary' WHEN c_custkey % 5 = 0 THEN 'code_block' WHEN c_custkey % 7 = 0 THEN 'image' ELSE 'section' END chunk_type,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE lpad((c_custkey % 3)::VARCHAR, 2, '0') || '_00_' || lpad((c_custkey // 3 % 100)::VARCHAR, 2, '0') END global_sort_key, c_mktsegment || '.md' file_path, 'f' || (c_custkey % 2) section_title,
  CASE WHEN c_custkey % 4 = 0 THEN 's' || c_custkey ELSE '' END subsection_title, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_mktsegment || ' > x' END breadcrumb, CASE WHEN c_custkey % 3 = 0 THEN 'router' ELSE 'core' END "source",
  CASE WHEN c_custkey % 3 = 1 THEN 'prose' ELSE '' END prose, CASE WHEN c_custkey % 2 = 0 THEN 'u' || c_custkey ELSE '' END url, ['a' || (c_custkey % 3), 'b' || (c_custkey % 4)] apis,
  ['guide/n' || (c_custkey % 5) || '.md', 'x#' || (c_custkey % 6), 'y', 'z', 'w', 'v'] refs FROM customer),
ordered AS (SELECT *, chunk_type LIKE '%_summary' alone, chunk_type = 'folder_summary' high, row_number() OVER (PARTITION BY "query" ORDER BY CASE WHEN chunk_type = 'folder_summary' THEN 0 ELSE 1 END, coalesce(global_sort_key, 'zzz'), rank) pos0 FROM hits WHERE rank <= 40),
runs0 AS (SELECT *, CASE WHEN lag(file_path) OVER w IS NULL OR lag(file_path) OVER w <> file_path OR high OR lag(high) OVER w THEN 1 ELSE 0 END np FROM ordered WINDOW w AS (PARTITION BY "query" ORDER BY pos0)),
runs AS (SELECT *, sum(np) OVER (PARTITION BY "query" ORDER BY pos0) page_run FROM runs0),
again AS (SELECT *, row_number() OVER (PARTITION BY "query" ORDER BY page_run, CASE WHEN alone THEN 0 ELSE 1 END, pos0) pos FROM runs),
lagged AS (SELECT *, lag(page_run) OVER w pr, lag(alone) OVER w pa, lag(section_title) OVER w ps, lag(global_sort_key) OVER w pk FROM again WINDOW w AS (PARTITION BY "query" ORDER BY pos)),
flags AS (SELECT *, CASE WHEN coalesce(pr = page_run AND NOT alone AND NOT pa AND ps IS NOT DISTINCT FROM section_title AND regexp_replace(global_sort_key, '\\d+$', '') = regexp_replace(pk, '\\d+$', '') AND abs(regexp_extract(global_sort_key, '(\\d+)$', 1)::BIGINT - regexp_extract(pk, '(\\d+)$', 1)::BIGINT) = 1, false) THEN 0 ELSE 1 END ng FROM lagged),
marked AS (SELECT *, sum(ng) OVER w merged FROM flags WINDOW w AS (PARTITION BY "query" ORDER BY pos))"""


def marked(spark, d):
    from pyspark.sql import Window

    key = F.col("c_custkey")
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))

    def two(x):
        return F.lpad(x.cast("string"), 2, "0")

    def named(prefix, x, end=""):
        return F.concat(F.lit(prefix), x.cast("string"), F.lit(end))

    kind = F.when(key % 17 == 0, "folder_summary").when(key % 19 == 0, "page_summary").when(key % 5 == 0, "code_block").when(key % 7 == 0, "image").otherwise("section")
    hits = table(spark, d, "customer").select(
        F.col("c_nationkey").alias("query"), key.alias("chunk_id"), rank.alias("rank"), kind.alias("chunk_type"),
        F.when(key % 11 != 0, F.concat_ws("_", two(key % 3), F.lit("00"), two(F.floor(key / 3) % 100))).alias("global_sort_key"), F.concat("c_mktsegment", F.lit(".md")).alias("file_path"),
        named("f", key % 2).alias("section_title"), F.when(key % 4 == 0, named("s", key)).alias("subsection_title"), F.when(key % 13 != 0, F.concat("c_mktsegment", F.lit(" > x"))).alias("breadcrumb"),
        F.when(key % 3 == 0, "router").otherwise("core").alias("source"), F.when(key % 3 == 1, "prose").alias("preceding_prose"), F.when(key % 2 == 0, named("u", key)).alias("image_url"),
        F.array(named("a", key % 3), named("b", key % 4)).alias("api_entities"), F.array(named("guide/n", key % 5, ".md"), named("x#", key % 6), *map(F.lit, "yzwv")).alias("cross_references"),
        F.col("c_mktsegment").alias("page_title"), key.cast("string").alias("content"), F.lit("js").alias("language_tag"),
    )
    return reconstruct.islands(reconstruct.reading_order(hits, 40))


@query("reading_order", f'WITH {READ_SQL} SELECT "query", chunk_id, pos::INT pos, page_run::BIGINT page_run, merged::BIGINT merged FROM marked')
def reading_order(spark, d):
    return marked(spark, d).select("query", "chunk_id", "pos", "page_run", "merged")


ANSWER_SQL = r"""hit AS (SELECT *, row_number() OVER (PARTITION BY "query", merged ORDER BY pos) - 1 i, CASE WHEN subsection_title <> '' THEN subsection_title ELSE section_title END title FROM marked),
part AS (SELECT *, CASE WHEN i = 0 THEN '### ' || title || chr(10) || chr(10) ELSE '' END head FROM hit),
parts AS (SELECT *, CASE chunk_type WHEN 'folder_summary' THEN '> [!NOTE]' || chr(10) || '> **Section Overview:** ' || chunk_id || chr(10) WHEN 'page_summary' THEN '> [!NOTE]' || chr(10) || '> **Overview:** ' || chunk_id || chr(10)
  WHEN 'code_block' THEN head || CASE WHEN prose <> '' THEN prose || chr(10) || chr(10) ELSE '' END || '```js' || chr(10) || chunk_id || chr(10) || '```' || chr(10)
  WHEN 'image' THEN head || CASE WHEN url <> '' THEN '![' || chunk_id || '](' || url || ')' ELSE '*[Image: ' || chunk_id || ']*' END || CASE WHEN prose <> '' THEN chr(10) || chr(10) || prose ELSE '' END || chr(10)
  ELSE head || chunk_id || chr(10) END text FROM part),
api AS (SELECT "query", merged, string_agg(api, ', ' ORDER BY m) apis FROM (SELECT "query", merged, api, min(pos * 10 + k) m FROM (SELECT "query", merged, pos, unnest(apis) api, unnest([1, 2]) k FROM marked) GROUP BY ALL) GROUP BY ALL),
ref AS (SELECT "query", merged, ref, min(pos * 10 + k) m FROM (SELECT "query", merged, pos, unnest(refs) ref, unnest([1, 2, 3, 4, 5, 6]) k FROM marked) GROUP BY ALL),
links AS (SELECT "query", merged, string_agg(CASE WHEN ref LIKE '%.md' THEN '[' || upper(ref[7]) || ref[8] || '](https://docs.example.org/' || replace(ref, '.md', '') || ')' ELSE ref END, ', ' ORDER BY m) refs FROM (SELECT *, row_number() OVER (PARTITION BY "query", merged ORDER BY m) n FROM ref) WHERE n <= 5 GROUP BY ALL),
groups AS (SELECT "query", merged, min(page_run) page_run, min(pos) pos, arg_min(breadcrumb, pos) crumb, arg_min("source", pos) src, arg_min(file_path, pos) file, arg_min(high, pos) high, string_agg(text, chr(10) ORDER BY pos) body FROM parts GROUP BY ALL),
whole AS (SELECT g.*, '---' || chr(10) || CASE WHEN crumb <> '' THEN 'breadcrumb: ' || crumb || chr(10) ELSE '' END || CASE WHEN src = 'router' THEN 'framework: Router' || chr(10) ELSE '' END || 'source: https://docs.example.org/' || replace(file, '.md', '') || chr(10)
  || 'apis: [' || apis || ']' || chr(10) || 'see_also: [' || refs || ']' || chr(10) || '---' || chr(10) || chr(10) || body text FROM groups g JOIN api USING ("query", merged) JOIN links USING ("query", merged)),
run AS (SELECT "query", page_run, CASE WHEN arg_min(high, pos) THEN '' ELSE '## ' || replace(arg_min(file, pos), '.md', '') || chr(10) || '<sup>[source](https://docs.example.org/' || replace(arg_min(file, pos), '.md', '') || ')</sup>' || chr(10) || chr(10) END || string_agg(text, chr(10) ORDER BY pos) text FROM whole GROUP BY ALL)"""


@query(
    "answer_assembly",
    f"""WITH {READ_SQL}, {ANSWER_SQL} SELECT n_nationkey "query", coalesce(string_agg(text, chr(10) || '---' || chr(10) || chr(10) ORDER BY page_run), 'No results found.') answer FROM (SELECT n_nationkey FROM nation UNION ALL SELECT 99) LEFT JOIN run ON "query" = n_nationkey GROUP BY 1""",
)
def answer_assembly(spark, d):
    queries = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("query")).unionByName(spark.range(99, 100).withColumnRenamed("id", "query"))
    return reconstruct.assemble(marked(spark, d), queries)
