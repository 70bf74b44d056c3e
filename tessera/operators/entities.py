"""Entity dictionaries and extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import api_names
from tessera.sources.markdown import front_matter


def dictionary(headings: DataFrame, types: dict[str, str], last: bool = True) -> DataFrame:
    """Names in headings of level 2, typed by the file's stem; of several files the last (or first) wins.

    headings: file_path, heading, ord.
    """
    typed = F.create_map(*[F.lit(x) for item in types.items() for x in item]) if types else F.create_map().cast("map<string,string>")
    rows = headings.select("file_path", "ord", F.explode(api_names(F.col("heading"))).alias("name"))
    stem = F.regexp_extract("file_path", r"([^/]+?)(?:\.md)?$", 1)
    order = Window.partitionBy("name").orderBy(F.desc("file_path") if last else F.col("file_path"), F.desc("ord") if last else F.col("ord"))
    rows = rows.withColumn("entity_type", F.coalesce(F.try_element_at(typed, stem), F.lit("other"))).withColumn("n", F.row_number().over(order))
    return rows.filter("n = 1").select("name", "entity_type", F.col("file_path").alias("page_path"))


def seeded(seeds: DataFrame, found: DataFrame) -> DataFrame:
    """Known names first, then names that were found; the first wins. Both: name, entity_type, ord."""
    union = seeds.select("name", "entity_type", F.lit(0).alias("prio"), "ord").unionByName(found.select("name", "entity_type", F.lit(1).alias("prio"), "ord"))
    order = Window.partitionBy("name").orderBy("prio", "ord")
    return union.withColumn("n", F.row_number().over(order)).filter("n = 1").select("name", "entity_type", "prio")


def by_directory(files: DataFrame, path: str = "path", text: str | None = None) -> DataFrame:
    """``{package}/{function}/index.md`` is an entity; the first package wins. text: where its front matter tells what is related."""
    parts = F.split(path, "/")
    rows = files.filter((F.size(parts) == 3) & F.col(path).endswith("/index.md")).select(F.element_at(parts, 2).alias("name"), F.element_at(parts, 1).alias("package"), path, *([front_matter(F.col(text))["related"].alias("related")] if text else []))
    names = ["package", path, *(["related"] if text else [])]
    first = rows.groupBy("name").agg(F.min(F.struct(*names)).alias("f"))
    return first.select("name", "f.package", F.col(f"f.{path}").alias("page_path"), *(["f.related"] if text else []), typed(F.col("name"), "composables").alias("entity_type"))


def by_pattern(name: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """E5: the first pattern that a name fits tells its type."""
    out = F.when(F.lit(False), default)
    for pattern, kind in rules:
        out = out.when(name.rlike(pattern), kind)
    return out.otherwise(default)


COMPONENT = (r"^\p{Lu}(?!\p{Lu})", "component")
# Ordered rules that type a name, by source; the first that fits tells.
RULES = {
    "generic": [("^use", "composable"), ("^create", "global_api"), ("^define", "compiler_macro"), ("^v-", "directive"), COMPONENT, (r"\.", "instance_method")],
    "router": [("^use", "composable"), ("^create", "global_api"), ("^(before|after|onBefore)", "navigation_guard"), COMPONENT, (r"\.", "instance_method")],
    "store": [(r"^\$", "instance_method"), ("^(create|define|map|set|get)", "global_api"), ("^use", "composable"), COMPONENT],
    "testing": [(r"^vi\.", "utility"), (r"^(test|describe|bench|expect)\.", "global_api"), ("^(before|after|around|onTest)", "lifecycle_hook"), ("^(define|merge)", "global_api"), COMPONENT],
    "meta": [("^use", "composable"), ("^(create|define)", "global_api"), ("^(onBefore|onAfter|onNuxt|onPre)", "lifecycle_hook"), COMPONENT],
    "composables": [("^use", "composable"), ("^create", "global_api"), ("^on", "lifecycle_hook"), (r"^\p{Lu}", "component"), ("", "utility")],
    "devtools": [("^(add|remove|create|define)", "global_api"), ("^on", "lifecycle_hook"), COMPONENT],
}


def typed(name: Column, source: str) -> Column:
    """The type of a name by the rules of its source; sources without rules of their own take the general ones."""
    return by_pattern(name, RULES.get(source, RULES["generic"]))


def heading_name(heading: Column) -> Column:
    """The name that a heading is, without slug, backticks, angle brackets and call parentheses; null for prose."""
    text = F.trim(F.regexp_replace(heading, r"\s*\{#[^}]+\}", ""))
    text = F.regexp_replace(F.regexp_replace(text, r"^`([^`]+)`.*$", "$1"), r"^<(.+?)/?>$", "$1")
    text = F.trim(F.regexp_replace(text, r"\(\)$", ""))
    prose = text.contains(" ") & ~text.contains(".") & ~text.rlike(r"^(v-|\$)")
    return F.when(~prose & (text != ""), text)


API_FOLDERS = ("api", "reference", "API")


def from_headings(headings: DataFrame, source: str) -> DataFrame:
    """Names in headings of levels 2 and 3 of files in API folders, index files apart; the first in file order wins.

    headings: file_path, level, heading, ord.
    """
    folder = F.array_position(F.array(*map(F.lit, API_FOLDERS)), F.split_part(F.col("file_path"), F.lit("/"), F.lit(1)))
    rows = headings.filter((folder > 0) & F.col("level").isin(2, 3) & ~F.col("file_path").endswith("/index.md")).withColumn("name", heading_name(F.col("heading")))
    order = Window.partitionBy("name").orderBy(folder, "file_path", "ord")
    first = rows.filter("name is not null").withColumn("n", F.row_number().over(order)).filter("n = 1")
    return first.select("name", typed(F.col("name"), source).alias("entity_type"), F.col("file_path").alias("page_path"), F.trim("heading").alias("section"), F.lit(source).alias("source"))


def mentioned(chunks: DataFrame, names: DataFrame, imports: list[str] | None = None) -> DataFrame:
    """(chunk_id, name) of dictionary names in inline code and, where there is code, in import lists and directives."""
    text = F.col("content")
    inline = F.regexp_extract_all(text, F.lit("`([^`\n]+)`"), F.lit(1))
    packages = "|".join(imports or [r"[^'\"]+"])
    lists = F.regexp_extract_all(text, F.lit(rf"import\s*\{{([^}}]*)\}}\s*from\s*['\"](?:{packages})['\"]"), F.lit(1))
    imported = F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda x: F.trim(F.regexp_replace(x, r"\s+as\s+.*$", "")))
    directives = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\w-])(v-[\w-]+)"), F.lit(1)), lambda x: x)
    code = (F.col("chunk_type") == "code_block") | text.contains("```")
    found = F.concat(inline, F.when(code, F.concat(imported, directives)).otherwise(F.array().cast("array<string>")))
    rows = chunks.select("chunk_id", F.explode(F.array_distinct(F.transform(found, lambda x: F.lower(F.trim(F.regexp_replace(x, r"\(\)$", "")))))).alias("low"))
    return rows.join(names.select("name", F.lower("name").alias("low")).distinct(), "low").select("chunk_id", "name").distinct()


def per_chunk(found: DataFrame) -> DataFrame:
    """E9."""
    return found.groupBy("chunk_id").agg(F.array_sort(F.collect_set("name")).alias("api_entities"))


def inverted(found: DataFrame, order: str = "chunk_id") -> DataFrame:
    """Chunk ids of each entity, in order."""
    return found.groupBy("name").agg(F.array_sort(F.collect_set(order)).alias("chunk_ids"))
