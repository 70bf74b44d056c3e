"""Stored chunks, incremental runs as a whole, and their state."""

from pyspark.sql import functions as F

from tessera.operators import graph, incremental, payloads
from tessera.plans.tables import table
from tessera.registry import query


def stored(spark, d):
    """Chunks of files ``f{doc_id // 4}.md`` as they are stored; some fields missing."""
    key = F.col("doc_id")
    kind = F.when(key % 11 == 0, "page_summary").when(key % 5 == 0, "code_block").otherwise("section")
    return table(spark, d, "documents").select(
        F.concat(F.lit("d"), key.cast("string")).alias("chunk_id"), F.col("source"), F.concat(F.lit("f"), F.floor(key / 4).cast("string"), F.lit(".md")).alias("file_path"), F.lit(".").alias("folder_path"),
        F.coalesce("lang", F.lit("")).alias("page_title"), F.lit("s").alias("section_title"), F.lit("b").alias("breadcrumb"), F.lit("00").alias("global_sort_key"), kind.alias("chunk_type"),
        F.when(key % 2 == 0, "options").alias("api_style"), F.when(key % 3 == 0, F.array("source")).alias("api_entities"), F.coalesce("text", F.lit("")).alias("content"),
        F.array(F.lit("one?"), F.lit("two?")).alias("hype_questions"),
    )


@query(
    "chunk_payloads",
    """SELECT 'd' || doc_id chunk_id, CASE WHEN doc_id % 2 = 0 THEN 'options' ELSE 'both' END api_style, CASE WHEN doc_id % 3 = 0 THEN ["source"] ELSE [] END api_entities, 'text' content_type, ''::VARCHAR language_tag, []::VARCHAR[] cross_references, ''::VARCHAR contextual_prefix, length(coalesce(text, ''))::INT n FROM documents""",
)
def chunk_payloads(spark, d):
    """To stored fields and back, missing ones filled."""
    back = payloads.chunks_of(payloads.payload(stored(spark, d)))
    return back.select("chunk_id", "api_style", "api_entities", "content_type", "language_tag", "cross_references", "contextual_prefix", F.length("content").alias("n"))


@query(
    "question_payloads",
    """SELECT 'd' || doc_id || '#hype#' || i chunk_id, 'd' || doc_id parent_chunk_id, (['one?', 'two?'])[i + 1] AS content, 'hype_question' chunk_type, 'f' || (doc_id // 4) || '.md' file_path, CASE WHEN doc_id % 3 = 0 THEN ["source"] ELSE [] END api_entities, CASE WHEN doc_id % 2 = 0 THEN 'options' ELSE 'both' END api_style FROM documents, range(0, 2) r(i)""",
)
def question_payloads(spark, d):
    """K10, N7."""
    return payloads.question_payload(stored(spark, d)).select("chunk_id", "parent_chunk_id", "content", "chunk_type", "file_path", "api_entities", "api_style")


@query("replace_by_source", """SELECT doc_id, "source", CASE WHEN "source" IN ('src1', 'src2', 'src3') THEN 'new' ELSE 'old' END kind FROM documents WHERE "source" NOT IN ('src1', 'src2', 'src3') OR doc_id % 40 < 20""")
def replace_by_source(spark, d):
    """K1, K2."""
    old = table(spark, d, "documents").select("doc_id", "source", F.lit("old").alias("kind"))
    new = old.filter(F.col("source").isin("src1", "src2", "src3") & (F.col("doc_id") % 40 < 20)).withColumn("kind", F.lit("new"))
    return payloads.replaced(old, new)


@query("collection_stats", "SELECT count(*) points, 'green' status FROM documents")
def collection_stats(spark, d):
    """R10."""
    return payloads.collection_stats(stored(spark, d))


FILES = """f AS (SELECT DISTINCT doc_id // 4 k, 'f' || (doc_id // 4) || '.md' path FROM documents), ch AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'deleted' WHEN k % 7 = 0 THEN 'new' WHEN k % 3 = 0 OR k % 11 = 0 THEN 'changed' ELSE 'unchanged' END change FROM f WHERE NOT (k % 5 = 0 AND k % 7 = 0)),
c AS (SELECT 'd' || doc_id chunk_id, doc_id // 4 k, CASE WHEN doc_id % 11 = 0 THEN 'page_summary' WHEN doc_id % 5 = 0 THEN 'code_block' ELSE 'section' END chunk_type FROM documents)"""


def run(spark, d):
    key = F.floor(F.col("doc_id") / 4)
    files = table(spark, d, "documents").select(key.alias("k")).distinct().withColumn("path", F.concat(F.lit("f"), F.col("k").cast("string"), F.lit(".md")))
    hashed = lambda mark: F.sha2(F.concat("path", mark), 256).alias("content_hash")
    current = files.filter("k % 5 <> 0").select("path", hashed(F.lit("")))
    ids = stored(spark, d).groupBy(F.col("file_path").alias("path")).agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
    state = files.filter("k % 7 <> 0").join(ids, "path")
    state = state.select("path", hashed(F.when(F.col("k") % 3 == 0, "x").otherwise("")), F.when(F.col("k") % 11 == 0, "v1").otherwise("v2").alias("version"), "chunk_ids")
    return incremental.Run(state, current, "v2")


@query("run_listing", f"WITH {FILES} SELECT CASE WHEN change = 'deleted' THEN '-' ELSE '+' END sign, path FROM ch WHERE change <> 'unchanged'")
def run_listing(spark, d):
    """What a dry run tells."""
    return run(spark, d).listing()


@query("run_reloaded", f"WITH {FILES} SELECT chunk_id FROM c JOIN ch USING (k) WHERE change = 'unchanged' AND chunk_type NOT LIKE '%_summary'")
def run_reloaded(spark, d):
    """I5."""
    return run(spark, d).reloaded(stored(spark, d)).select("chunk_id")


@query("run_purged", f"WITH {FILES} SELECT chunk_id FROM c LEFT JOIN ch USING (k) WHERE coalesce(change, '') NOT IN ('changed', 'deleted') AND chunk_type NOT LIKE '%_summary'")
def run_purged(spark, d):
    """No stale chunks, no summaries."""
    return run(spark, d).purged(stored(spark, d)).select("chunk_id")


@query(
    "run_state",
    f"WITH {FILES}, ids AS (SELECT k, list_sort(list(chunk_id)) chunk_ids FROM c GROUP BY k) SELECT path, sha256(path) content_hash, 'v2' AS version, chunk_ids FROM ch JOIN ids USING (k) WHERE change <> 'deleted'",
)
def run_state(spark, d):
    """I8: the state that a run leaves."""
    return run(spark, d).next_state(stored(spark, d))


@query("state_totals", f"WITH {FILES} SELECT count(*) chunks FROM c JOIN f USING (k) WHERE k % 7 <> 0 AND k % 2 = 0")
def state_totals(spark, d):
    """Removal, and the total of chunk ids."""
    state = incremental.State(run(spark, d).state)
    odd = state.paths().filter(F.regexp_extract("path", r"(\d+)", 1).cast("long") % 2 == 1)
    return state.remove(odd).total_chunks()


@query("reference_totals", 'SELECT count(*) "references", count(DISTINCT doc_id) chunks FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents WHERE doc_id % 2 = 0)')
def reference_totals(spark, d):
    """A20, G1-G4."""
    content = F.concat(F.lit("[a](/x/y.md) and [b](/x/y.html)"), F.when(F.col("doc_id") % 2 == 0, " [c](/z)").otherwise(""))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit("g/p.md").alias("file_path"), content.alias("content"))
    return graph.total_references(graph.references(rows, []))
