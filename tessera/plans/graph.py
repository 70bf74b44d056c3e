"""Links of pages, their targets and kinds, expansion, related entities."""

from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.plans.tables import table
from tessera.registry import query

PAIRS = [("en", "de"), ("fr", "es")]
LINKS_SQL = r"""p AS (SELECT 'p' || page_id chunk_id, regexp_extract(url, 'https?://[^/]+/([^?#]*)', 1) file_path, list_transform(range(0, 4), lambda i: CASE i WHEN 0 THEN '[a](/de/' || (page_id % 50) || '.html#top)' WHEN 1 THEN '[b](../fr/' || (page_id % 30) || '.md)' WHEN 2 THEN '[c](https://x.org/y)' ELSE '[d](' || (page_id * 7 % 40) || '/)' END) l FROM pages),
raw AS (SELECT chunk_id, file_path, unnest(range(0, 4)) ord, unnest(list_transform(l, lambda x: regexp_extract(x, '\[([^\]]*)\]\(([^)\s]+)\)', 1))) label, unnest(list_transform(l, lambda x: regexp_extract(x, '\[([^\]]*)\]\(([^)\s]+)\)', 2))) link FROM p),
resolved AS (SELECT chunk_id, file_path, ord, label, CASE WHEN link LIKE 'http%' THEN NULL WHEN link LIKE '/%' THEN regexp_replace(regexp_replace(ltrim(split_part(link, '#', 1), '/'), '\.(html|md)$', ''), '/+$', '') || regexp_extract(link, '(#.*)$', 1)
  WHEN link LIKE '../%' THEN regexp_replace(regexp_replace(file_path, '[^/]*$', ''), '[^/]+/$', '') || regexp_replace(link[4:], '\.(html|md)$', '') ELSE regexp_replace(file_path, '[^/]*$', '') || rtrim(link, '/') END target FROM raw),
typed AS (SELECT *, CASE WHEN least(split_part(file_path, '/', 1), split_part(target, '/', 1)) || '|' || greatest(split_part(file_path, '/', 1), split_part(target, '/', 1)) IN ('de|en', 'es|fr') THEN 'high'
  WHEN array_to_string(string_split(file_path, '/')[1:2], '/') = array_to_string(string_split(regexp_replace(target, '#.*$', ''), '/')[1:2], '/') THEN 'medium' ELSE 'low' END kind FROM resolved WHERE target IS NOT NULL),
edges AS (SELECT chunk_id source_chunk_id, target, label, kind, ord::INT ord FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, target ORDER BY ord) n FROM typed) WHERE n = 1)"""


def chunks(spark, d):
    n = F.col("page_id")
    content = F.concat(
        F.lit("[a](/de/"), (n % 50).cast("string"), F.lit(".html#top) [b](../fr/"), (n % 30).cast("string"), F.lit(".md) [c](https://x.org/y) [d]("),
        (n * 7 % 40).cast("string"), F.lit("/)"),
    )
    return table(spark, d, "pages").select(F.concat(F.lit("p"), n.cast("string")).alias("chunk_id"), F.regexp_extract("url", "https?://[^/]+/([^?#]*)", 1).alias("file_path"), content.alias("content"))


def edges(spark, d):
    return graph.references(chunks(spark, d), PAIRS)


@query("cross_references", f"WITH {LINKS_SQL} SELECT * FROM edges")
def cross_references(spark, d):
    return edges(spark, d)


@query("graph_adjacency", f"WITH {LINKS_SQL} SELECT source_chunk_id, list(target ORDER BY ord) targets FROM edges GROUP BY 1")
def graph_adjacency(spark, d):
    return graph.adjacency(edges(spark, d))


@query(
    "html_links",
    r"""SELECT page_id, ord::INT ord, link FROM (SELECT page_id, unnest(l) link, unnest(range(0, len(l))) ord FROM (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1) l FROM pages))""",
)
def html_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("ord", "link"))


HITS_SQL = """hits AS (SELECT page_id % 20 "query", 'p' || page_id chunk_id, row_number() OVER (PARTITION BY page_id % 20 ORDER BY page_id * 37 % 101, page_id) rank FROM pages)"""


def hits(spark, d):
    from pyspark.sql import Window

    n = F.col("page_id")
    order = Window.partitionBy(n % 20).orderBy(n * 37 % 101, n)
    return table(spark, d, "pages").select((n % 20).alias("query"), F.concat(F.lit("p"), n.cast("string")).alias("chunk_id"), F.row_number().over(order).alias("rank"), F.lit(1.0).alias("score"))


TARGETS_SQL = f"""WITH {LINKS_SQL}, {HITS_SQL},
open AS (SELECT "query", target, CASE kind WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END prio, rank, ord FROM hits JOIN edges ON chunk_id = source_chunk_id WHERE kind = 'high' OR (kind = 'medium' AND rank - 1 < 10) OR (kind = 'low' AND rank - 1 < 5)),
best AS (SELECT "query", target, min(prio) prio, min(rank * 1000 + ord) seen FROM open GROUP BY ALL),
cut AS (SELECT *, row_number() OVER (PARTITION BY "query" ORDER BY prio, CASE WHEN contains(target, '#') THEN 0 ELSE 1 END, seen, target) n FROM best)"""


@query("expansion_targets", TARGETS_SQL + ' SELECT "query", target, prio::INT prio, n::INT n FROM cut WHERE n <= 10')
def expansion_targets(spark, d):
    return graph.targets(hits(spark, d), edges(spark, d))


@query(
    "expansion",
    TARGETS_SQL
    + """, pagesx AS (SELECT 'q' || page_id chunk_id, regexp_extract(url, 'https?://[^/]+/([^/]*)/', 1) || '/' || (page_id % 50) file_path FROM pages),
    more AS (SELECT DISTINCT "query", c.chunk_id FROM cut JOIN pagesx c ON file_path = target WHERE n <= 10 AND NOT contains(target, '#'))
    SELECT "query", chunk_id, 1.0::DOUBLE score FROM hits UNION ALL SELECT "query", chunk_id, 0.0::DOUBLE FROM more""",
)
def expansion(spark, d):
    n = F.col("page_id")
    top = F.regexp_extract("url", "https?://[^/]+/([^/]*)/", 1)
    rows = table(spark, d, "pages").select(
        F.concat(F.lit("q"), n.cast("string")).alias("chunk_id"), F.concat(top, F.lit("/"), (n % 50).cast("string"), F.lit(".md")).alias("file_path"), F.lit("section").alias("chunk_type")
    )
    return graph.expand(hits(spark, d), edges(spark, d), rows)


@query(
    "related_entities",
    """WITH e AS (SELECT n_name AS name, n_regionkey, 'N' || n_nationkey kind FROM nation), m AS (SELECT r_regionkey "query", 'NATION_' || r_regionkey AS name, 0 ord FROM region),
    near AS (SELECT m."query", b.name, 1 hop, (SELECT count(*) FROM e x WHERE x.n_regionkey = a.n_regionkey AND x.name < b.name) pos FROM m JOIN e a USING (name) JOIN e b ON a.n_regionkey = b.n_regionkey),
    u AS (SELECT "query", name, 0 hop, 0 pos FROM m UNION ALL SELECT * FROM near), f AS (SELECT "query", name, min(hop * 1000 + pos) place FROM u GROUP BY ALL)
    SELECT "query", f.name, (place // 1000)::INT hop, coalesce(kind, '—') entity_type, row_number() OVER (PARTITION BY "query" ORDER BY place, f.name)::INT n FROM f LEFT JOIN e ON e.name = f.name""",
)
def related_entities(spark, d):
    nation = table(spark, d, "nation")
    peers = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("related"))
    entities = nation.join(peers, "n_regionkey").select(F.col("n_name").alias("name"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("entity_type"), "related")
    matched = table(spark, d, "region").select(F.col("r_regionkey").alias("query"), F.concat(F.lit("NATION_"), F.col("r_regionkey").cast("string")).alias("name"), F.lit(0).alias("ord"))
    return graph.related(matched, entities)
