"""The facade as a whole: search, lookups, related names, resources, prompts."""

from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.operators import resources
from tessera.plans.search import WORDS
from tessera.plans.tables import table
from tessera.registry import query


def text(before, column, after=""):
    return F.concat(F.lit(before), column.cast("string"), F.lit(after))


def chunks(spark, d):
    key = F.col("doc_id")
    return table(spark, d, "documents").select(
        text("d", key).alias("chunk_id"), F.col("text").alias("content"), text("p", key, ".md").alias("file_path"), F.col("lang").alias("section_title"), F.lit("").alias("breadcrumb"),
        F.lpad(key.cast("string"), 9, "0").alias("global_sort_key"), F.lit("section").alias("chunk_type"), F.lit("").alias("language_tag"), F.col("source").alias("folder_path"), F.lit("core").alias("source"),
        text("Page ", key).alias("page_title"),
    )


def short_name():
    return F.replace("n_name", F.lit("NATION_"), F.lit("Nat")).alias("name")


def entities(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        short_name(), F.lit("global_api").alias("entity_type"), F.when(F.col("n_nationkey") % 3 > 0, text("n/", F.col("n_nationkey"), ".md")).otherwise("").alias("page_path"),
        F.when(F.col("n_nationkey") % 2 == 0, F.lit("`Use` it {#use}")).otherwise("").alias("section"),
        F.when(F.col("n_nationkey") % 5 > 0, F.array("r_name", text("x", F.col("n_nationkey")))).otherwise(F.array().cast("array<string>")).alias("related"),
        F.when(F.col("n_nationkey") % 4 == 0, "router").otherwise("core").alias("source"),
    )


def mentions(spark, d):
    rows = table(spark, d, "customer").filter("c_nationkey % 7 > 0").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(short_name(), text("c", F.col("c_custkey")).alias("chunk_id"))


def synonyms(spark):
    return spark.createDataFrame([], "alias string, names array<string>")


def engine(spark, d):
    return Engine(chunks(spark, d), entities(spark, d), synonyms(spark), mentions=mentions(spark, d))


ENTITIES = """nat AS (SELECT * REPLACE (replace(n_name, 'NATION_', 'Nat') AS n_name) FROM nation), e AS (SELECT n_name AS name, CASE WHEN n_nationkey % 3 > 0 THEN 'https://docs.example.org/n/' || n_nationkey END url, n_nationkey, n_nationkey % 2 = 0 sec, CASE WHEN n_nationkey % 5 > 0 THEN '`' || r_name || '`, `x' || n_nationkey || '`' END rel,
    CASE WHEN n_nationkey % 4 = 0 THEN 'router' ELSE 'core' END src, CASE WHEN n_nationkey % 7 > 0 THEN (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) ELSE 0 END n FROM nat JOIN region ON n_regionkey = r_regionkey)"""


def asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")


COVER_SQL = f"""places AS (SELECT doc, unnest(ws) token, unnest(range(len(ws))) pos FROM w),
own AS (SELECT "query", doc FROM hits WHERE rank <= 50),
met AS (SELECT "query", doc, token, pos FROM own JOIN places USING (doc) JOIN qt USING ("query", token)),
words AS (SELECT "query", count(*) t FROM qt GROUP BY 1),
matched AS (SELECT "query", doc, count(DISTINCT token) m FROM met GROUP BY ALL),
ahead AS (SELECT a."query", a.doc, a.pos s, b.token, min(b.pos) p FROM met a JOIN met b ON a."query" = b."query" AND a.doc = b.doc AND b.pos >= a.pos GROUP BY ALL),
runs AS (SELECT "query", doc, s, max(p) AS last, count(*) c FROM ahead GROUP BY "query", doc, s),
cover AS (SELECT "query", doc, m, min(last - s + 1) len FROM runs JOIN matched USING ("query", doc) WHERE c = m GROUP BY "query", doc, m)"""
ANSWERS_SQL = """s AS (SELECT "query", doc, '## Page ' || doc || chr(10) || '<sup>[source](https://docs.example.org/p' || doc || ')</sup>' || chr(10) || chr(10) || '---' || chr(10) || 'source: https://docs.example.org/p' || doc || chr(10) || '---' || chr(10) || chr(10)
      || CASE WHEN lang IS NULL THEN '' ELSE '### ' || lang || chr(10) || chr(10) END || text || chr(10) t FROM best JOIN documents ON doc = doc_id WHERE n <= 3)
    SELECT item_id "query", coalesce(string_agg(t, chr(10) || '---' || chr(10) || chr(10) ORDER BY doc), 'No documentation found for: ' || any_value(b.text)) answer FROM benchmark b LEFT JOIN s ON "query" = item_id GROUP BY item_id"""
SEARCH_SQL = f"""w AS (SELECT doc_id doc, {WORDS.format(t='text')} ws FROM documents),
size AS (SELECT count(*) n, avg(len(ws)) avgdl FROM w),
tf AS (SELECT doc, dl, token, count(*) tf FROM (SELECT doc, len(ws) dl, unnest(ws) token FROM w) GROUP BY ALL),
df AS (SELECT token, count(*) df FROM tf GROUP BY token),
postings AS (SELECT doc, token, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) weight FROM tf JOIN df USING (token), size),
qt AS (SELECT DISTINCT item_id "query", unnest({WORDS.format(t='text')}) token FROM benchmark),
scores AS (SELECT "query", doc, round(sum(weight), 6) score FROM postings JOIN qt USING (token) GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY "query" ORDER BY score DESC, 'd' || doc) rank FROM scores)"""


@query(
    "search",
    f"""WITH {SEARCH_SQL}, hits AS (SELECT * FROM sparse), {COVER_SQL},
    scored AS (SELECT "query", doc, round(greatest(0, (0.5::DOUBLE * m / t + 0.2::DOUBLE * m / len) / 0.7::DOUBLE) * 1.5::DOUBLE - 0.5, 6) score FROM cover JOIN words USING ("query")),
    best AS (SELECT *, row_number() OVER (PARTITION BY "query" ORDER BY score DESC, 'd' || doc) n FROM scored WHERE score >= -0.5), {ANSWERS_SQL}""",
)
def search(spark, d):
    """V1: the sparse leg, reranked by covers, in reading order, rendered."""
    return engine(spark, d).search(asked(spark, d))


@query(
    "search_hybrid",
    f"""WITH {SEARCH_SQL}, qv AS (SELECT item_id "query", embedding::DOUBLE[] qvec FROM benchmark JOIN embeddings ON vec_id = item_id),
    cv AS (SELECT doc_id doc, embedding::DOUBLE[] vec FROM documents JOIN embeddings ON vec_id = doc_id),
    near AS (SELECT "query", doc, list_dot_product(qvec, vec) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(qvec, qvec))) cosine FROM qv, cv),
    dense AS (SELECT "query", doc, row_number() OVER (PARTITION BY "query" ORDER BY round(cosine, 6) DESC, 'd' || doc) rank FROM near),
    legs AS (SELECT "query", doc, rank FROM sparse WHERE rank <= 50 UNION ALL SELECT "query", doc, rank FROM dense WHERE rank <= 50),
    parts AS (SELECT "query", doc, round(sum(1.0::DOUBLE / (2 + rank - 1)), 6) score FROM legs GROUP BY ALL),
    hits AS (SELECT *, row_number() OVER (PARTITION BY "query" ORDER BY score DESC, 'd' || doc) rank FROM parts), {COVER_SQL},
    scored AS (SELECT own."query", own.doc, round(greatest(0, 0.5::DOUBLE * coalesce(m, 0) / t + 0.2::DOUBLE * coalesce(m / len, 0) + 0.3::DOUBLE * coalesce(cosine, 0)) * 1.5::DOUBLE - 0.5, 6) score
      FROM own JOIN words USING ("query") LEFT JOIN cover ON cover."query" = own."query" AND cover.doc = own.doc LEFT JOIN near ON near."query" = own."query" AND near.doc = own.doc),
    best AS (SELECT *, row_number() OVER (PARTITION BY "query" ORDER BY score DESC, 'd' || doc) n FROM scored WHERE score >= -0.5), {ANSWERS_SQL}""",
)
def search_hybrid(spark, d):
    """V1: both legs fused, reranked by covers and vectors, in reading order, rendered."""
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    own = chunks(spark, d).join(vectors.withColumn("chunk_id", text("d", F.col("vec_id"))).drop("vec_id"), "chunk_id", "left")
    queries = asked(spark, d).join(vectors.select(F.col("vec_id").alias("query"), F.col("vec").alias("qvec")), "query", "left")
    return Engine(own, entities(spark, d), synonyms(spark), mentions=mentions(spark, d)).search(queries)


def lookups(spark, d):
    low = F.lower(short_name())
    name = F.when(F.col("n_nationkey") % 6 == 5, "zq").when(F.col("n_nationkey") % 6 == 4, F.concat(F.lit("about "), low)).otherwise(low)
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("query"), name.alias("text"))


@query(
    "api_lookup",
    f"""WITH {ENTITIES}, q AS (SELECT n_nationkey "query", CASE WHEN n_nationkey % 6 = 4 THEN (SELECT min(name) FROM e WHERE contains(lower(n_name), lower(name))) ELSE n_name END AS name FROM nat)
    SELECT "query", CASE WHEN "query" % 6 = 5 THEN 'No API entity found for `zq`.' || chr(10) || chr(10) || '**Next step:** Use `core_docs_search` with query `"zq"` for a broader documentation search.'
      ELSE '# `' || name || '`' || chr(10) || chr(10) || '> **Global Api**' || CASE WHEN url IS NULL THEN '' ELSE chr(10) || '> ' || url END || CASE WHEN sec THEN ' — Use it' ELSE '' END || chr(10) || chr(10)
      || CASE WHEN n = 0 AND rel IS NULL THEN '' ELSE '| Property | Value |' || chr(10) || '|----------|-------|' || chr(10) || concat_ws(chr(10), CASE WHEN n > 0 THEN '| Documentation chunks | ' || n || ' |' END, '| Related APIs | ' || rel || ' |') || chr(10) || chr(10) END
      || '**Next steps:**' || chr(10) || '- `core_docs_search` with query `"' || name || '"` for full documentation content' || CASE WHEN rel IS NULL THEN '' ELSE chr(10) || '- `core_api_lookup` on related APIs: ' || rel END END answer FROM q JOIN e USING (name)""",
)
def api_lookup(spark, d):
    """V2: by name in any case, else the first match, else none."""
    return engine(spark, d).api_lookup(lookups(spark, d), "core")


@query(
    "related_names",
    f"""WITH {ENTITIES}, q AS (SELECT n_nationkey "query", n_name || ' and ' || lag(n_name, 1, 'zq') OVER (ORDER BY n_nationkey) AS text FROM nat),
    m AS (SELECT "query", n_name AS name, n_nationkey k, r_name FROM q, nat JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(text), lower(n_name))),
    a AS (SELECT "query", name, 0 hop, name o, 0 b FROM m UNION ALL SELECT "query", unnest([r_name, 'x' || k]), 1, name, unnest([0, 1]) FROM m WHERE k % 5 > 0),
    f AS (SELECT "query", name, min(hop) hop, min(struct_pack(hop := hop, o := o, b := b)) seen FROM a GROUP BY ALL)
    SELECT "query", name, hop::INT hop, CASE WHEN name IN (SELECT n_name FROM nat) THEN 'global_api' ELSE '—' END entity_type, row_number() OVER (PARTITION BY "query" ORDER BY seen, name)::INT n FROM f""",
)
def related_names(spark, d):
    """V3: in match order."""
    from pyspark.sql import Window

    nations = table(spark, d, "nation").select("n_nationkey", short_name())
    before = F.lag("name", 1, "zq").over(Window.partitionBy(F.lit(0)).orderBy("n_nationkey"))  # the 25 nations
    queries = nations.select(F.col("n_nationkey").alias("query"), F.concat_ws(" and ", "name", before).alias("text"))
    return engine(spark, d).related(queries)


@query(
    "entity_cards",
    f"""WITH {ENTITIES} SELECT name, '# `' || name || '`' || chr(10) || chr(10) || '| Property | Value |' || chr(10) || '|----------|-------|' || chr(10) || '| **Type** | Global Api |' || chr(10)
      || CASE WHEN url IS NULL THEN '' ELSE '| **Documentation** | [' || url || '](' || url || ') |' || chr(10) || '| **Page resource** | `' || src || '://pages/n/' || n_nationkey || '` |' || chr(10) END
      || CASE WHEN sec THEN '| **Section** | Use it |' || chr(10) ELSE '' END || CASE WHEN n > 0 THEN '| **References** | ' || n || ' documentation chunks |' || chr(10) ELSE '' END
      || CASE WHEN rel IS NULL THEN '' ELSE chr(10) || '## Related APIs' || chr(10) || chr(10) || rel || chr(10) END AS text FROM e""",
)
def entity_cards(spark, d):
    """A9."""
    return engine(spark, d).entity_cards()


@query(
    "topics_contents",
    """WITH p AS (SELECT 'r' || n_regionkey folder, 'r' || n_regionkey || '/n-' || n_nationkey || '.md' path, n_nationkey k FROM nation),
    f AS (SELECT folder, 'R' || substr(folder, 2) head, string_agg('- [N ' || k || '](core://pages/' || replace(path, '.md', '') || ')', chr(10) ORDER BY path) l FROM p GROUP BY 1)
    SELECT '# Core Documentation — Table of Contents' || chr(10) || chr(10) || '> **' || (SELECT count(*) FROM p) || '** pages across **' || (SELECT count(*) FROM f) || '** sections' || chr(10) || chr(10) || string_agg('## ' || head || chr(10) || chr(10) || l || chr(10), chr(10) ORDER BY folder) AS text FROM f""",
)
def topics_contents(spark, d):
    """A6, V5."""
    path = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/n-"), F.col("n_nationkey").cast("string"), F.lit(".md"))
    return resources.contents(table(spark, d, "nation").select(path.alias("path")), "core", "Core")


@query("source_preferences", "SELECT 'p' || doc_id || '.md' path FROM documents WHERE doc_id % 3 = 1")
def source_preferences(spark, d):
    """V4: only what the chosen sources hold."""
    whole = engine(spark, d)
    key = F.regexp_extract("chunk_id", r"(\d+)", 1).cast("long")
    kind = F.when(key % 3 == 0, "core").when(key % 3 == 1, "router").otherwise("store")
    return Engine(whole.chunks.withColumn("source", kind), whole.entities, whole.synonyms).for_sources(["router"]).pages().select("path")


@query(
    "resource_registry",
    """WITH now AS (SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'router' ELSE 'core' END || '://api/entities/' || replace(n_name, 'NATION_', 'Nat') uri FROM nation UNION SELECT 'core://pages/p' || doc_id FROM documents UNION SELECT 'core://topics/a' FROM documents WHERE false),
    was AS (SELECT uri FROM now WHERE NOT contains(uri, '1') UNION SELECT 'core://pages/old')
    SELECT coalesce(now.uri, was.uri) uri, CASE WHEN was.uri IS NULL THEN 'add' WHEN now.uri IS NULL THEN 'remove' ELSE 'keep' END "action" FROM now FULL JOIN was ON now.uri = was.uri""",
)
def resource_registry(spark, d):
    """V7."""
    now = engine(spark, d).addresses()
    was = now.filter(~F.col("uri").contains("1")).unionByName(spark.createDataFrame([("core://pages/old",)], "uri string"))
    return resources.registry_changes(was, now)


@query(
    "server_prompts",
    """SELECT p_partkey, '## Issue' || chr(10) || chr(10) || p_name || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || '```' || chr(10) || p_type || chr(10) || '```' ELSE '' END || chr(10) || chr(10) || 'Find the Core concept with `core_docs_search`, look up its APIs with `core_api_lookup`, compare with `core_get_related`, then tell the cause, the fix and how to prevent it.' debug,
    '## Compare in Core: `' || p_brand || '`, `' || p_type || '`' || chr(10) || chr(10) || '- `core_api_lookup` on `"' || p_brand || '"`' || chr(10) || '- `core_api_lookup` on `"' || p_type || '"`' compare,
    '## Migrate in Core: ' || p_brand || ' → ' || p_type || chr(10) || chr(10) || '- `core_docs_search` with query `"' || p_brand || '"`' || chr(10) || '- `core_docs_search` with query `"' || p_type || '"`' migrate FROM part""",
)
def server_prompts(spark, d):
    """V6."""
    code = F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    return table(spark, d, "part").select(
        "p_partkey", resources.debug_prompt(F.col("p_name"), code, "Core", "core").alias("debug"), resources.compare_prompt(F.concat_ws(" , ", "p_brand", F.lit(""), "p_type"), "Core", "core").alias("compare"),
        resources.migrate_prompt(F.col("p_brand"), F.col("p_type"), "Core", "core").alias("migrate"),
    )


@query("capped_responses", "SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 1978) || chr(10) || chr(10) || '[Response truncated]' ELSE text END AS text FROM documents")
def capped_responses(spark, d):
    """V16, with a lower limit."""
    return table(spark, d, "documents").select("doc_id", resources.capped(F.col("text"), 2000).alias("text"))
