"""Structure of markdown files, sources, names in headings, small text functions."""

from pyspark.sql import functions as F

from tessera.cluster import dealt
from tessera.functions import subwords
from tessera.functions import text as T
from tessera.operators import entities, markdown, match, ordering
from tessera.plans.tables import table
from tessera.registry import query
from tessera.sources import markdown as sources


def text_of(column):
    return column.cast("string")


def key_text(spark, d):
    return dealt(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey").select("p_partkey", text_of(F.col("p_partkey")).alias("k"), "p_name", "p_brand", "p_type", "p_size")


def lines(*parts):
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def named(before, column, after=""):
    return F.concat(F.lit(before), column, F.lit(after))


@query(
    "markdown_subsections",
    """WITH p AS (SELECT p_partkey k, 'p' || p_partkey s, CASE WHEN p_partkey % 3 = 0 THEN repeat('i', 120) ELSE 'short' END intro, CASE WHEN p_partkey % 2 = 0 THEN 1600 ELSE 1 END n FROM part),
    t AS (SELECT *, '## A' || chr(10) || intro top, '### One' || chr(10) || repeat('x', n) one, '### Two {#two-x}' || chr(10) || repeat('y', n) two FROM p),
    c AS (SELECT s || '#t' || k chunk_id, '' parent, 'section' kind, '# T' || k || chr(10) || 'just text' AS content, []::VARCHAR[] siblings, []::VARCHAR[] children FROM t WHERE k % 7 = 0
      UNION ALL SELECT s || '#b', '', 'section', '## B' || chr(10) || 'end', [s || '#a'], [] FROM t WHERE k % 7 <> 0
      UNION ALL SELECT s || '#a', '', 'section', CASE WHEN n > 1 THEN top ELSE top || chr(10) || one || chr(10) || two END, [s || '#b'], CASE WHEN n > 1 THEN [s || '#one', s || '#two-x'] ELSE [] END FROM t WHERE k % 7 <> 0 AND (n = 1 OR k % 3 = 0)
      UNION ALL SELECT s || '#one', s || '#a', 'subsection', top || chr(10) || chr(10) || one, [s || '#two-x'], [] FROM t WHERE k % 7 <> 0 AND n > 1
      UNION ALL SELECT s || '#two-x', s || '#a', 'subsection', top || chr(10) || chr(10) || two, [s || '#one'], [] FROM t WHERE k % 7 <> 0 AND n > 1)
    SELECT chunk_id, parent parent_chunk_id, kind chunk_type, content, siblings sibling_chunk_ids, children child_chunk_ids FROM c""",
)
def markdown_subsections(spark, d):
    """Long sections cut at headings of level 3, short ones whole, files without sections."""
    key = F.col("p_partkey")
    n = F.when(key % 2 == 0, 1600).otherwise(1)
    intro = F.when(key % 3 == 0, "i" * 120).otherwise("short")
    whole = lines(named("# T", F.col("k")), "## A", intro, "### One", F.repeat(F.lit("x"), n), "### Two {#two-x}", F.repeat(F.lit("y"), n), "## B", "end")
    made = F.when(key % 7 == 0, lines(named("# T", F.col("k")), "just text")).otherwise(whole)
    files = key_text(spark, d).select(named("g/p", F.col("k"), ".md").alias("path"), made.alias("text"))
    return markdown.chunks(files).select("chunk_id", "parent_chunk_id", "chunk_type", "content", "sibling_chunk_ids", "child_chunk_ids")


@query(
    "image_chunks",
    """WITH p AS (SELECT p_partkey k, 'p' || p_partkey s FROM part), mid AS (SELECT *, '## S' || chr(10) || 'before' || chr(10) || '![a](i' || k || '.png) ![b](j.png)' || chr(10) || 'after' || chr(10) || '```' prose FROM p)
    SELECT s || '#s-img-0' chunk_id, s || '#s' parent_chunk_id, '![a](i' || k || '.png)' AS content, prose preceding_prose, substr(sha256('i' || k || '.png'), 1, 16) content_hash FROM mid
    UNION ALL SELECT s || '#s-img-1', s || '#s', '![b](j.png)', prose, substr(sha256('j.png'), 1, 16) FROM mid
    UNION ALL SELECT s || '#r-img-0', s || '#r', '![c](k.png)', '## R' || chr(10) || '![c](k.png)', substr(sha256('k.png'), 1, 16) FROM p""",
)
def image_chunks(spark, d):
    """P9."""
    made = lines("# T", "## S", "before", named("![a](i", F.col("k"), ".png) ![b](j.png)"), "after", "```", "![no](x.png)", "```", "## R", "![c](k.png)")
    files = key_text(spark, d).select(named("p", F.col("k"), ".md").alias("path"), made.alias("text"))
    return markdown.image_chunks(files).select("chunk_id", "parent_chunk_id", "content", "preceding_prose", "content_hash")


@query(
    "section_styles",
    """SELECT 'p' || p_partkey || '#' || unnest(['a', 'b', 'c']) chunk_id, unnest([CASE WHEN p_partkey % 2 = 0 THEN 'both' ELSE 'options' END, 'composition', 'both']) api_style FROM part""",
)
def section_styles(spark, d):
    """P10."""
    more = F.when(F.col("p_partkey") % 2 == 0, '<div class="composition-api">\nz\n</div>').otherwise("plain")
    made = lines("# T", "## A", '<div class="options-api">', "x", "</div>", more, "## B", '<div class="composition-api">', "y", "</div>", "## C", "</div>", "end")
    files = key_text(spark, d).select(named("p", F.col("k"), ".md").alias("path"), made.alias("text"))
    return markdown.section_styles(files).select("chunk_id", "api_style")


CLEANED = {
    "core": (('<div class="options-api">\nkeep ', "\n</div>\n[Playground](u)\nend"), ("keep ", "\n\nend")),
    "router": (('a <RouterLink to="x">kept</RouterLink> ', '<VueSchoolLink href="x">z</VueSchoolLink> b\n<HomeSponsors />\n<script setup>\nimport x\n</script>\nend'), ('a <RouterLink to="x">kept</RouterLink> ', " b\n\nend")),
    "store": (('<MasteringPiniaLink href="x" />\n', "\n\n\n\n<RuleKitLink>\nend  "), ("", "\n\nend")),
    "composables": (('<CourseLink href="x">v</CourseLink>\n```ts twoslash\n// ---cut-start---\nhidden\n// ---cut-end---\n// @include: x\n', "\n```\n// ---cut-start---\nend"), ("```ts\n", "\n```\n// ---cut-start---\nend")),
    "bundler": (('a <ScrimbaLink href="x">v</ScrimbaLink>', ' b<audio src="x"></audio>\n<!-- prettier-ignore -->\nend'), ("a ", " b\n\nend")),
    "testing": (("a <Version>1</Version>", '<Badge type="x">new</Badge> b <CRoot /> c\n<img img-light src="x">\nend'), ("a ", " b  c\n\nend")),
    "meta": (("::read-more{to='/x'}\nkept\n", "\n::tip\nin\n::\n :video-accordion{x}\n::link-example{to='y'}\nend"), ("kept\n", "\n::tip\nin\n::\n\nend")),
    "devtools": (("<Home />\n", "\n<UseModeList />"), ("", "")),
}


def sql_text(text):
    return "'" + text.replace("'", "''") + "'"


@query("clean_sources", " UNION ALL ".join(f"SELECT p_partkey, '{s}' \"source\", {sql_text(a)} || p_name || {sql_text(b)} AS text FROM part" for s, (_, (a, b)) in CLEANED.items()))
def clean_sources(spark, d):
    """The cleaning of every source."""
    rows = None
    for source, ((before, after), _) in CLEANED.items():
        own = table(spark, d, "part").select("p_partkey", F.lit(source).alias("source"), sources.adapter(source).cleaned(named(before, F.col("p_name"), after)).alias("text"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


FILES = ("guide/a.md", "zh/b.md", "blog/x.md", "index.md", ".vitepress/c.md", "guide/cli-generated.md", "guide/examples/d.md", "core/useX/index.md", "core/useX/other.md", "5.community/e.md", "team.md", "components/f.md", "api/g.md", "dist/useY/index.md", "nuxt/useZ/index.md", "other/useW/index.md", "public/p.md", "add-ons.md")
LEFT_OUT = {
    "core": (), "router": ("zh/b.md",), "store": ("zh/b.md",), "composables": ("zh/b.md", "blog/x.md", ".vitepress/c.md", "core/useX/other.md", "5.community/e.md", "team.md", "api/g.md", "dist/useY/index.md", "other/useW/index.md", "public/p.md"),
    "bundler": ("blog/x.md", ".vitepress/c.md", "index.md", "team.md", "public/p.md"), "testing": ("blog/x.md", ".vitepress/c.md", "index.md", "team.md", "guide/cli-generated.md", "guide/examples/d.md", "public/p.md"),
    "meta": ("5.community/e.md",), "devtools": (".vitepress/c.md", "index.md", "public/p.md"),
}


@query(
    "discover_sources",
    f"""WITH f AS (SELECT p_partkey, ({list(FILES)!r})[p_partkey % {len(FILES)} + 1] path FROM part) """
    + " UNION ALL ".join(f"SELECT p_partkey, '{s}' \"source\", path FROM f" + (f" WHERE path NOT IN ({', '.join(map(sql_text, gone))})" if gone else "") for s, gone in LEFT_OUT.items()),
)
def discover_sources(spark, d):
    """The file rules of every source."""
    files = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, FILES)), (F.col("p_partkey") % len(FILES) + 1).cast("int")).alias("path"))
    rows = None
    for source in LEFT_OUT:
        own = sources.adapter(source).discover(files).select("p_partkey", F.lit(source).alias("source"), "path")
        rows = own if rows is None else rows.unionByName(own)
    return rows


@query("embed_texts", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_brand || chr(10) || chr(10) || p_name END AS text FROM part")
def embed_texts(spark, d):
    """P23."""
    prefix = F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).when(F.col("p_size") % 2 == 0, "")
    return table(spark, d, "part").select("p_partkey", T.with_prefix(prefix, F.col("p_name")).alias("text"))


@query("section_titles", "SELECT p_partkey, p_name || ' of ' || p_type AS title FROM part")
def section_titles(spark, d):
    """P26."""
    made = F.concat(F.lit(" `"), "p_name", F.lit("` of <sup class='x'>new</sup>  "), "p_type", F.lit(" <Badge/> {#own-"), F.col("p_size").cast("string"), F.lit("}"))
    return table(spark, d, "part").select("p_partkey", T.section_title(made).alias("title"))


@query("labels_and_prefixes", "SELECT p_partkey, 'Global Api ' || p_size AS label, 'my_tool_' || p_size AS tool_prefix FROM part")
def labels_and_prefixes(spark, d):
    """P27, P28."""
    size = F.col("p_size").cast("string")
    return table(spark, d, "part").select("p_partkey", T.label(named("global_api_", size)).alias("label"), T.tool_prefix(named("my-tool-", size)).alias("tool_prefix"))


@query("token_counts", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]'))::INT tokens FROM documents")
def token_counts(spark, d):
    """P32."""
    return table(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("subword_counts")
def subword_counts(spark, d):
    """P32 by a byte-pair vocabulary; no SQL: held against the vocabulary's own library in the tests."""
    return table(spark, d, "documents").select("doc_id", subwords.counter(spark)(F.col("text")).alias("tokens"))


@query("source_paths", "SELECT p_partkey, ['guide/p' || p_partkey, 'api/x', 'other/' || p_size] paths FROM part")
def source_paths(spark, d):
    """P33."""
    made = F.concat(F.lit("see https://docs.example.org/guide/P"), F.col("p_partkey").cast("string"), F.lit(".html and (https://example.org/api/x/), https://else.org/no\nSource: https://else.net/Other/"), F.col("p_size").cast("string"), F.lit(".md\nhttps://example.org/api/x"))
    return table(spark, d, "part").select("p_partkey", T.paths_in(made, r"example\.org").alias("paths"))


@query("code_context_names", "SELECT p_partkey, [lower(p_brand), 'v-model', 'model', 'if', 'comp' || p_size, 'prop'] AS names FROM part")
def code_context_names(spark, d):
    """M3."""
    made = F.concat(F.lit("use `"), "p_brand", F.lit("` and `v-model` with v-if on <Comp"), F.col("p_size").cast("string"), F.lit("> or its .prop"))
    return table(spark, d, "part").select("p_partkey", match.code_names(made).alias("names"))


@query(
    "heading_entities",
    """WITH h AS (SELECT p_partkey k, unnest(['use' || p_size, 'create' || p_size, 'app.mount' || p_size, 'Comp' || p_size]) AS name, unnest(['`use' || p_size || '()` {#x}', 'create' || p_size, 'app.mount' || p_size || '()', '<Comp' || p_size || '/>']) section, unnest(['composable', 'global_api', 'instance_method', 'component']) entity_type FROM part WHERE p_partkey % 4 < 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN k % 4 = 0 THEN 1 ELSE 2 END, 'p' || k) n FROM h)
    SELECT name, entity_type, CASE WHEN k % 4 = 0 THEN 'api/p' ELSE 'reference/p' END || k || '.md' page_path, section FROM o WHERE n = 1""",
)
def heading_entities(spark, d):
    """API folders only, prose left out, the first file wins."""
    size = F.col("p_size").cast("string")
    folder = F.when(F.col("p_partkey") % 4 == 0, "api/p").when(F.col("p_partkey") % 4 == 1, "reference/p").otherwise("guide/p")
    heads = F.array(named("`use", size, "()` {#x}"), named("create", size), named("app.mount", size, "()"), named("<Comp", size, "/>"), F.lit("Some words of prose"))
    rows = key_text(spark, d).select(F.concat(folder, "k", F.lit(".md")).alias("file_path"), F.posexplode(heads).alias("ord", "heading"), F.lit(2).alias("level"))
    return entities.from_headings(rows, "generic").select("name", "entity_type", "page_path", "section")


@query(
    "directory_entities",
    """SELECT 'use' || p_size AS name, min(CASE WHEN p_partkey % 2 = 0 THEN 'core' ELSE 'shared' END) package, 'composable' entity_type, arg_min(rel, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END) related FROM (SELECT *, ['rel' || (p_size % 7), 'x'] rel FROM part) WHERE p_partkey % 3 > 0 GROUP BY 1""",
)
def directory_entities(spark, d):
    """The first package wins; related names from the front matter."""
    size = F.col("p_size").cast("string")
    package = F.when(F.col("p_partkey") % 2 == 0, "core").otherwise("shared")
    path = F.concat(package, F.lit("/use"), size, F.when(F.col("p_partkey") % 3 > 0, "/index.md").otherwise("/demo.md"))
    text = F.concat(F.lit("---\ncategory: a\nrelated: rel"), (F.col("p_size") % 7).cast("string"), F.lit(", x\n---\ntext"))
    rows = table(spark, d, "part").select(path.alias("path"), text.alias("text"))
    return entities.by_directory(rows, text="text").select("name", "package", "entity_type", "related")


@query(
    "seeded_entities",
    """SELECT coalesce(s.name, f.name) AS name, CASE WHEN s.name IS NULL THEN 'found' ELSE 'seed' END entity_type, CASE WHEN s.name IS NULL THEN 1 ELSE 0 END::INT prio FROM (SELECT DISTINCT p_brand AS name FROM part WHERE p_size % 2 = 0) s FULL JOIN (SELECT DISTINCT p_brand AS name FROM part WHERE p_size % 3 = 0) f ON s.name = f.name""",
)
def seeded_entities(spark, d):
    """Seeds first, then what was found; the first wins."""
    part = table(spark, d, "part")

    def of(rows, kind):
        return rows.select(F.col("p_brand").alias("name"), F.lit(kind).alias("entity_type"), F.col("p_partkey").alias("ord"))

    return entities.seeded(of(part.filter("p_size % 2 = 0"), "seed"), of(part.filter("p_size % 3 = 0"), "found"))


NAMES = ("useX", "createX", "onBeforeX", "Thing", "a.b", "$reset", "vi.fn", "expect.extend", "defineX", "v-x", "plain", "XMLThing", "removeX", "beforeEach")
TYPES = {
    "router": ["composable", "global_api", "navigation_guard", "component", "instance_method", "other", "instance_method", "instance_method", "other", "other", "other", "other", "other", "navigation_guard"],
    "store": ["composable", "global_api", "other", "component", "other", "instance_method", "other", "other", "global_api", "other", "other", "other", "other", "other"],
    "testing": ["other", "other", "other", "component", "other", "other", "utility", "global_api", "global_api", "other", "other", "other", "other", "lifecycle_hook"],
    "devtools": ["other", "global_api", "lifecycle_hook", "component", "other", "other", "other", "other", "global_api", "other", "other", "other", "global_api", "other"],
    "core": ["composable", "global_api", "other", "component", "instance_method", "other", "instance_method", "instance_method", "compiler_macro", "directive", "other", "other", "other", "other"],
}


@query("typed_names", " UNION ALL ".join(f"SELECT p_partkey, '{s}' \"source\", (({kinds!r})[p_partkey % {len(NAMES)} + 1]) entity_type FROM part" for s, kinds in TYPES.items()))
def typed_names(spark, d):
    """Each source's rules; the core has none here and takes the general ones."""
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % len(NAMES) + 1).cast("int"))
    rows = None
    for source in TYPES:
        own = table(spark, d, "part").select("p_partkey", F.lit(source).alias("source"), entities.typed(name, source).alias("entity_type"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


SIDEBAR = """
'/guide/': [
  { text: 'A', items: [ { text: 'a', link: '/guide/a' }, { link: '/guide/b.html#top' } ] },
  { text: 'B', items: [ { link: '/guide/c' } ] },
],
'/': [ ...more(), { items: [ { link: '/api/' } ] } ],
function more() { return [ { text: 'C', items: [ { link: '/data/x' }, { link: '/data/y' } ] } ] }
"""


@query("sidebar_sort_keys", "SELECT unnest(['guide/a', 'guide/b', 'guide/c', 'api', 'data/x', 'data/y']) path, unnest(['00_00_00', '00_00_01', '00_01_00', '01_00_00', '00_02_00', '00_02_01']) sort_key")
def sidebar_sort_keys(spark, d):
    """O1, O3."""
    return spark.createDataFrame(list(ordering.sidebar(SIDEBAR, ("more",)).items()), "path string, sort_key string")


@query("guide_sort_keys", "SELECT p_partkey, (['00_00_00', '00_00_02', '00_01_01', NULL])[p_partkey % 4 + 1] sort_key FROM part")
def guide_sort_keys(spark, d):
    """Pages in a fixed order."""
    path = F.element_at(F.array(*map(F.lit, ("guide/index", "guide/config", "add-ons", "core/useX/index"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", ordering.of_guide(path).alias("sort_key"))
