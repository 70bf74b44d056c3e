"""Entity matching and dictionaries."""

from pyspark.sql import functions as F

from tessera.cluster import dealt
from tessera.operators import entities, match
from tessera.plans.tables import table
from tessera.registry import query

NAMES = "names AS (SELECT DISTINCT p_name AS name FROM part)"
QUERIES = """queries AS (SELECT p_partkey "query", 'how to use ' || p_name || ' with ' || p_brand AS text FROM part)"""


def names(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()


def queries(spark, d):
    part = dealt(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey")
    return part.select(F.col("p_partkey").alias("query"), F.concat(F.lit("how to use "), "p_name", F.lit(" with "), "p_brand").alias("text"))


@query("match_exact", f"""WITH {NAMES}, {QUERIES} SELECT "query", name FROM queries, names WHERE contains(lower(text), lower(name))""")
def match_exact(spark, d):
    return match.exact(queries(spark, d), names(spark, d))


@query(
    "match_bigram",
    f"""WITH {QUERIES}, n AS (SELECT DISTINCT replace(p_name, ' ', '') AS name FROM part), w AS (SELECT "query", list_filter(regexp_split_to_array(lower(text), '[\\s\\-_.,;:!?()]+'), lambda x: x <> '') w FROM queries),
    p AS (SELECT DISTINCT "query", unnest(list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1])) low FROM w)
    SELECT "query", name FROM p JOIN n ON low = lower(name)""",
)
def match_bigram(spark, d):
    return match.bigram(queries(spark, d), names(spark, d).select(F.replace("name", F.lit(" "), F.lit("")).alias("name")).distinct())


SYNONYMS = "synonyms AS (SELECT lower(p_brand) alias, list_sort(list_distinct(list(p_name))) names FROM part GROUP BY 1)"


def synonyms(spark, d):
    return table(spark, d, "part").groupBy(F.lower("p_brand").alias("alias")).agg(F.array_sort(F.collect_set("p_name")).alias("names"))


@query("match_synonym", f"""WITH {QUERIES}, {SYNONYMS} SELECT DISTINCT "query", unnest(names) AS name FROM queries, synonyms WHERE contains(lower(text), alias)""")
def match_synonym(spark, d):
    return match.synonym(queries(spark, d), synonyms(spark, d))


@query("match_fuzzy")
def match_fuzzy(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    typos = words.select(F.xxhash64("name").alias("query"), F.concat("name", F.right("name", F.lit(1))).alias("text"))
    empty = typos.limit(0).select("query", F.col("text").alias("name"))
    return match.fuzzy(typos, words, empty)


@query(
    "match_priority",
    f"""WITH {NAMES}, {QUERIES}, {SYNONYMS}, u AS (SELECT "query", name, 0 prio FROM queries, names WHERE contains(lower(text), lower(name)) UNION ALL SELECT "query", unnest(names), 2 FROM queries, synonyms WHERE contains(lower(text), alias))
    SELECT "query", name, CASE min(prio) WHEN 0 THEN 'exact' ELSE 'synonym' END AS source FROM u GROUP BY ALL""",
)
def match_priority(spark, d):
    return match.match(queries(spark, d), names(spark, d), synonyms(spark, d))


@query("entity_lookup", """WITH e AS (SELECT n_name AS name, n_nationkey FROM nation) SELECT n_nationkey "query", lower(n_name) AS text, n_name AS name FROM nation""")
def entity_lookup(spark, d):
    nation = table(spark, d, "nation")
    wanted = nation.select(F.col("n_nationkey").alias("query"), F.lower("n_name").alias("text"))
    return match.lookup(wanted, nation.select(F.col("n_name").alias("name"))).select("query", "text", "name")


CODE = """'Use `' || p_name || '` and ' || p_brand || '.' || CASE WHEN p_size % 2 = 0 THEN chr(10) || '```js' || chr(10) || 'import { ' || replace(p_brand, '#', '') || ' as x, y } from ''lib''' || chr(10) || '```' ELSE '' END"""


def code_chunks(spark, d):
    fence = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\n```js\nimport { "), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(" as x, y } from 'lib'\n```"))).otherwise("")
    content = F.concat(F.lit("Use `"), "p_name", F.lit("` and "), "p_brand", F.lit("."), fence)
    return table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.lit("section").alias("chunk_type"), content.alias("content"))


def code_names(spark, d):
    part = table(spark, d, "part")
    return part.select(F.col("p_name").alias("name")).unionByName(part.select(F.replace("p_brand", F.lit("#"), F.lit("")).alias("name"))).distinct()


ENTITIES_SQL = f"""c AS (SELECT p_partkey chunk_id, {CODE} content FROM part),
n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT replace(p_brand, '#', '') FROM part),
f AS (SELECT DISTINCT chunk_id, name FROM (SELECT chunk_id, lower(trim(unnest(list_concat(regexp_extract_all(content, '`([^`\\n]+)`', 1),
  CASE WHEN contains(content, '```') THEN list_transform(string_split(regexp_extract(content, 'import\\s*\\{{([^}}]*)\\}}', 1), ','), lambda x: trim(regexp_replace(x, '\\s+as\\s+.*$', ''))) ELSE [] END)))) low FROM c) JOIN n ON low = lower(name))"""


@query("entity_extraction", f"WITH {ENTITIES_SQL} SELECT chunk_id, list_sort(list(name)) api_entities FROM f GROUP BY 1")
def entity_extraction(spark, d):
    return entities.per_chunk(entities.mentioned(code_chunks(spark, d), code_names(spark, d)))


@query("entity_inverted_index", f"WITH {ENTITIES_SQL} SELECT name, list_sort(list(chunk_id)) chunk_ids FROM f GROUP BY 1")
def entity_inverted_index(spark, d):
    return entities.inverted(entities.mentioned(code_chunks(spark, d), code_names(spark, d)))


@query(
    "entity_dictionary",
    """WITH r AS (SELECT p_type, p_partkey, trim(unnest(string_split(p_brand || ' & ' || replace(p_name, ' ', '-'), '&'))) AS name FROM part), o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_type DESC, p_partkey DESC) n FROM r WHERE NOT regexp_matches(name, '\\s'))
    SELECT name, CASE p_type WHEN 'ECONOMY' THEN 'function' ELSE 'other' END entity_type, p_type page_path FROM o WHERE n = 1""",
)
def entity_dictionary(spark, d):
    heads = table(spark, d, "part").select(F.col("p_type").alias("file_path"), F.concat_ws(" & ", F.col("p_brand"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("heading"), F.col("p_partkey").alias("ord"))
    return entities.dictionary(heads, {"ECONOMY": "function"})


@query(
    "entity_classification",
    "SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' THEN 'directive' WHEN regexp_matches(p_type, 'STEEL$') THEN 'component' WHEN regexp_matches(p_type, '^[A-M]') THEN 'function' ELSE 'other' END entity_type FROM part",
)
def entity_classification(spark, d):
    kind = entities.by_pattern(F.col("p_type"), [("^PROMO", "directive"), ("STEEL$", "component"), ("^[A-M]", "function")])
    return table(spark, d, "part").select("p_partkey", kind.alias("entity_type"))


GUARDED = """'size ' || p_size || ' of ' || p_size || '0, key ' || CASE WHEN p_size % 2 = 0 THEN '`data`' ELSE 'data' END || ' v-is <h' || (p_size % 3) || '>'"""


@query(
    "match_guarded",
    f"""WITH q AS (SELECT p_partkey "query", {GUARDED} AS text FROM part),
    n AS (SELECT DISTINCT p_size::VARCHAR AS name FROM part UNION SELECT unnest(['data', 'key', 'is', 'h', 'h1', 'of'])),
    s AS (SELECT "query", name FROM q, n WHERE length(name) <= 3 AND regexp_matches(replace(lower(text), '`', ''), '(^|[^A-Za-z0-9_])' || name || '($|[^A-Za-z0-9_])') AND name NOT IN ('data', 'key', 'is', 'h'))
    SELECT * FROM s UNION ALL SELECT "query", 'data' FROM q WHERE contains(text, '`data`') UNION ALL SELECT "query", 'is' FROM q""",
)
def match_guarded(spark, d):
    """M4: short names only between non-word characters, common words only as code."""
    part = dealt(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    size = F.col("p_size").cast("string")
    data = F.when(F.col("p_size") % 2 == 0, "`data`").otherwise("data")
    asked = part.select(F.col("p_partkey").alias("query"), F.concat(F.lit("size "), size, F.lit(" of "), size, F.lit("0, key "), data, F.lit(" v-is <h"), (F.col("p_size") % 3).cast("string"), F.lit(">")).alias("text"))
    known = part.select(size.alias("name")).distinct().unionByName(part.limit(1).select(F.explode(F.array(*map(F.lit, ("data", "key", "is", "h", "h1", "of")))).alias("name"))).distinct()
    return match.exact(asked, known)
