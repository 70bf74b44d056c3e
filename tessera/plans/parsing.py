"""Markdown parsing and text functions over markdown made of the tables' rows."""

from pyspark.sql import functions as F

from tessera.cluster import dealt
from tessera.functions import text as T
from tessera.operators import markdown
from tessera.plans.tables import table
from tessera.registry import query
from tessera.sources.markdown import ADAPTERS, front_matter

MARKDOWN = """m AS (SELECT p_partkey, 'guide/' || replace(p_name, ' ', '-') || '-' || p_partkey || '.md' path, '# ' || p_name || chr(10) || 'intro' || chr(10) || '```sh' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || '## First ' || p_brand || chr(10) || 'text one' || chr(10) || '## Second {#second-' || p_size || '}' || chr(10) || 'text two' || chr(10) AS text FROM part)"""


def files(spark, d):
    lines = [
        F.concat(F.lit("# "), "p_name"), F.lit("intro"), F.lit("```sh"), F.lit("# no heading"), F.lit("```"), F.concat(F.lit("## First "), "p_brand"), F.lit("text one"),
        F.concat(F.lit("## Second {#second-"), F.col("p_size").cast("string"), F.lit("}")), F.lit("text two"), F.lit(""),
    ]
    path = F.concat(F.lit("guide/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".md"))
    return dealt(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey").select("p_partkey", path.alias("path"), F.concat_ws("\n", *lines).alias("text"))


@query(
    "markdown_headings",
    """SELECT p_partkey, unnest([1, 2, 2])::INT AS level, unnest([p_name, 'First ' || p_brand, 'Second']) title, unnest([replace(p_name, ' ', '-'), 'first-' || lower(replace(p_brand, '#', '')), 'second-' || p_size]) slug, unnest([0, 5, 7])::INT line FROM part""",
)
def markdown_headings(spark, d):
    return files(spark, d).select("p_partkey", F.explode_outer(markdown.headings(F.col("text"))).alias("h")).filter("h is not null").select("p_partkey", "h.level", "h.title", "h.slug", "h.line")


@query(
    "markdown_chunks",
    """WITH c AS (SELECT p_partkey, p_name, p_brand, p_size, replace(p_name, ' ', '-') || '-' || p_partkey stem FROM part), r AS (SELECT stem, p_name, unnest(['first-' || lower(replace(p_brand, '#', '')), 'second-' || p_size]) slug, unnest(['First ' || p_brand, 'Second']) section_title,
    unnest(['## First ' || p_brand || chr(10) || 'text one', '## Second {#second-' || p_size || '}' || chr(10) || 'text two']) AS content FROM c)
    SELECT stem || '#' || slug chunk_id, 'section' chunk_type, 'guide' folder_path, p_name || ' > ' || section_title breadcrumb, content, substr(sha256(content), 1, 16) content_hash FROM r""",
)
def markdown_chunks(spark, d):
    return markdown.chunks(files(spark, d)).select("chunk_id", "chunk_type", "folder_path", "breadcrumb", "content", "content_hash")


@query("slugs", r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(trim(text)), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-') slug FROM documents")
def slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("fence_languages", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'js,ts' ELSE 'sh' END languages FROM part")
def fence_languages(spark, d):
    code = F.when(F.col("p_size") % 2 == 0, "```ts\nx\n```\n```js\ny\n```\n```ts\nz\n```").otherwise("```sh\nx\n```")
    return table(spark, d, "part").select("p_partkey", T.fence_languages(code).alias("languages"))


@query("page_urls", "SELECT p_partkey, 'https://docs.example.org/guide/' || replace(p_name, ' ', '-') || '-' || p_partkey url FROM part")
def page_urls(spark, d):
    return files(spark, d).select("p_partkey", T.page_url(F.col("path"), F.lit("https://docs.example.org/")).alias("url"))


@query("front_matter", "SELECT p_partkey, p_type category, p_size % 2 = 0 deprecated, string_split(p_name, ' ') related FROM part")
def front_matters(spark, d):
    made = F.concat(F.lit("---\ncategory: "), "p_type", F.when(F.col("p_size") % 2 == 0, "\ndeprecated: true").otherwise(""), F.lit("\nrelated: "), F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit("\n---\ntext"))
    return table(spark, d, "part").select("p_partkey", front_matter(made).alias("f")).select("p_partkey", "f.category", "f.deprecated", "f.related")


@query(
    "file_discovery",
    """WITH f AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'blog/' WHEN 1 THEN 'guide/' WHEN 2 THEN '' WHEN 3 THEN 'guide/examples/' ELSE 'api/' END || CASE WHEN p_size % 3 = 0 THEN 'index.md' ELSE 'page-' || p_size || '.md' END path FROM part)
    SELECT p_partkey, path FROM f WHERE NOT starts_with(path, 'blog/') AND path <> 'index.md' AND NOT starts_with(path, 'guide/examples/')""",
)
def file_discovery(spark, d):
    n = F.col("p_partkey") % 5
    folder = F.when(n == 0, "blog/").when(n == 1, "guide/").when(n == 2, "").when(n == 3, "guide/examples/").otherwise("api/")
    name = F.when(F.col("p_size") % 3 == 0, "index.md").otherwise(F.concat(F.lit("page-"), F.col("p_size").cast("string"), F.lit(".md")))
    return ADAPTERS["testing"].discover(table(spark, d, "part").select("p_partkey", F.concat(folder, name).alias("path")))


@query("clean_components", "SELECT p_partkey, 'a ' || p_name || ' b' AS text FROM part")
def clean_components(spark, d):
    made = F.concat(F.lit("  a <Badge type='x' />"), "p_name", F.lit("<Version>1</Version> b\n<script setup>\nimport x\n</script>\n"))
    return table(spark, d, "part").select("p_partkey", F.regexp_replace(ADAPTERS["testing"].cleaned(made), r"\s+", " ").alias("text"))


@query("size_warnings", "SELECT doc_id, CASE WHEN length(text) > 8000 THEN 'long' WHEN length(text) < 50 THEN 'short' END warning FROM documents")
def size_warnings(spark, d):
    return table(spark, d, "documents").select("doc_id", T.size_warning(F.col("text")).alias("warning"))


@query("rerank_texts", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand || chr(10) || p_type || chr(10) || p_name WHEN p_size % 3 = 1 THEN p_brand || chr(10) || p_name ELSE p_name END AS text FROM part")
def rerank_texts(spark, d):
    kind = F.when(F.col("p_size") % 3 == 0, "code_block").otherwise("section")
    crumb = F.when(F.col("p_size") % 3 != 2, F.col("p_brand")).otherwise("")
    return table(spark, d, "part").select("p_partkey", T.rerank_text(kind, crumb, F.col("p_type"), F.col("p_name")).alias("text"))


@query("retry_delays", "SELECT n_nationkey, n_nationkey * 3600.0::DOUBLE + 30 + 1.5 AS seconds FROM nation")
def retry_delays(spark, d):
    made = F.concat(F.col("n_nationkey").cast("string"), F.lit("h0m31.5s"))
    return table(spark, d, "nation").select("n_nationkey", T.retry_seconds(made).alias("seconds"))
