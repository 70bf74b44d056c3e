"""Resources and prompts of a documentation server, as tables of addresses and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.analytics import folder_of
from tessera.sources.markdown import base_url

MOST_CHARS, EXAMPLES = 500_000, 15


def capped(text: Column, most: int = MOST_CHARS) -> Column:
    """Responses over the limit are cut, and say so."""
    note = "\n\n[Response truncated]"
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(note)), F.lit(note))).otherwise(text)


def bare(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md$", "")


def page_title(path: Column) -> Column:
    return F.initcap(F.replace(F.regexp_replace(bare(path), "^.*/", ""), F.lit("-"), F.lit(" ")))


def contents(pages: DataFrame, source: str, title: str, section: str | None = None) -> DataFrame:
    """One text: how many pages and sections, then the pages of each folder in order. pages: path (distinct)."""
    rows = pages.select("path", folder_of(F.col("path")).alias("folder"))
    if section is not None:
        rows = rows.filter((F.col("folder") == section) | F.col("folder").startswith(section + "/"))
    line = F.concat(F.lit("- ["), page_title(F.col("path")), F.lit(f"]({source}://pages/"), bare(F.col("path")), F.lit(")"))
    folders = rows.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))).alias("p"), F.count("*").alias("n"))
    head = F.when(F.col("folder") == "", "Root").otherwise(F.initcap(F.replace("folder", F.lit("/"), F.lit(" > "))))
    block = F.concat(F.lit("## "), head, F.lit("\n\n"), F.array_join(F.transform("p", lambda p: p["line"]), "\n"), F.lit("\n"))
    whole = folders.select("folder", block.alias("block"), "n").agg(F.array_sort(F.collect_list(F.struct("folder", "block"))).alias("b"), F.sum("n").alias("pages"), F.count("*").alias("sections"))
    top = F.concat(F.lit(f"# {title} Documentation — Table of Contents\n\n> **"), F.coalesce("pages", F.lit(0)).cast("string"), F.lit("** pages across **"), F.col("sections").cast("string"), F.lit("** sections\n\n"))
    return whole.select(F.concat(top, F.array_join(F.transform("b", lambda b: b["block"]), "\n")).alias("text"))


def type_label(kind: Column) -> Column:
    return F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))


def quoted(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("`"), n, F.lit("`"))), ", ")


def with_counts(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities with the number of chunks that name them. mentions: name, chunk_id."""
    return entities.join(mentions.groupBy("name").agg(F.countDistinct("chunk_id").alias("chunks")), "name", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def entity_card(entities: DataFrame) -> DataFrame:
    """Name, text. entities: name, entity_type, page_path, section, related, source, chunks."""
    address = T.page_url(F.col("page_path"), base_url(F.col("source")))
    lines = (
        F.concat(F.lit("# `"), "name", F.lit("`\n")),
        F.lit("| Property | Value |\n|----------|-------|"),
        F.concat(F.lit("| **Type** | "), type_label(F.col("entity_type")), F.lit(" |")),
        F.when(F.col("page_path") != "", F.concat(F.lit("| **Documentation** | ["), address, F.lit("]("), address, F.lit(") |\n| **Page resource** | `"), "source", F.lit("://pages/"), bare(F.col("page_path")), F.lit("` |"))),
        F.when(F.col("section") != "", F.concat(F.lit("| **Section** | "), T.section_title(F.col("section")), F.lit(" |"))),
        F.when(F.col("chunks") > 0, F.concat(F.lit("| **References** | "), F.col("chunks").cast("string"), F.lit(" documentation chunks |"))),
        F.lit(""),
        F.when(F.size("related") > 0, F.concat(F.lit("## Related APIs\n\n"), quoted(F.col("related")), F.lit("\n"))),
    )
    return entities.select("name", F.concat_ws("\n", *lines).alias("text"))


def lookup_text(found: DataFrame, prefix: str = "ecosystem") -> DataFrame:
    """V2: query, answer. found: query, asked and, null where there is none, the columns of ``entity_card``."""
    search = "ecosystem_search" if prefix == "ecosystem" else f"{prefix}_docs_search"
    lookup = search if prefix == "ecosystem" else f"{prefix}_api_lookup"
    missing = F.concat(F.lit("No API entity found for `"), "asked", F.lit(f"`.\n\n**Next step:** Use `{search}` with query `\""), "asked", F.lit('"` for a broader documentation search.'))
    place = F.when(F.col("page_path") != "", F.concat(F.lit("> "), T.page_url(F.col("page_path"), base_url(F.col("source")))))
    section = F.when(F.col("section") != "", F.concat(F.lit(" — "), T.section_title(F.col("section")))).otherwise("")
    kind = F.concat(F.lit("> **"), type_label(F.col("entity_type")), F.lit("**"))
    head = F.when(place.isNotNull(), F.concat(kind, F.lit("\n"), place, section)).otherwise(F.concat(kind, section))
    chunks = F.when(F.col("chunks") > 0, F.concat(F.lit("| Documentation chunks | "), F.col("chunks").cast("string"), F.lit(" |")))
    related = F.when(F.size("related") > 0, F.concat(F.lit("| Related APIs | "), quoted(F.col("related")), F.lit(" |")))
    table = F.concat(F.lit("| Property | Value |\n|----------|-------|\n"), F.concat_ws("\n", chunks, related), F.lit("\n"))
    lines = (
        F.concat(F.lit("# `"), "name", F.lit("`\n")), head, F.lit(""), F.when(chunks.isNotNull() | related.isNotNull(), table), F.lit("**Next steps:**"),
        F.concat(F.lit(f"- `{search}` with query `\""), "name", F.lit('"` for full documentation content')),
        F.when(F.size("related") > 0, F.concat(F.lit(f"- `{lookup}` on related APIs: "), quoted(F.slice("related", 1, 3)))),
    )
    return found.select("query", F.when(F.col("name").isNull(), missing).otherwise(F.concat_ws("\n", *lines)).alias("answer"))


def addresses(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """V7: address of every page, entity and section. pages: source, path; entities: source, name."""
    page = pages.select(F.concat("source", F.lit("://pages/"), bare(F.col("path"))).alias("uri"))
    entity = entities.select(F.concat("source", F.lit("://api/entities/"), "name").alias("uri"))
    top = F.split_part(F.col("path"), F.lit("/"), F.lit(1))
    section = pages.filter(F.col("path").contains("/")).select(F.concat("source", F.lit("://topics/"), top).alias("uri"))
    return page.unionByName(entity).unionByName(section).distinct()


def registry_changes(registered: DataFrame, current: DataFrame) -> DataFrame:
    """V7: uri and what to do with it: add, remove or keep."""
    old, new = registered.select("uri", F.lit(True).alias("was")), current.select("uri", F.lit(True).alias("now"))
    action = F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "remove").otherwise("keep")
    return old.join(new, "uri", "full").select("uri", action.alias("action"))


def items_of(text: Column) -> Column:
    """V6: names from a list with commas."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def debug_prompt(symptom: Column, code: Column, title: str, prefix: str) -> Column:
    """V6: how to find the reason of a problem with the tools of a source."""
    block = F.when(F.coalesce(code, F.lit("")) != "", F.concat(F.lit("\n\n```\n"), code, F.lit("\n```"))).otherwise("")
    steps = f"\n\nFind the {title} concept with `{prefix}_docs_search`, look up its APIs with `{prefix}_api_lookup`, compare with `{prefix}_get_related`, then tell the cause, the fix and how to prevent it."
    return F.concat(F.lit("## Issue\n\n"), symptom, block, F.lit(steps))


def compare_prompt(items: Column, title: str, prefix: str) -> Column:
    """V6: how to compare APIs; a lookup for each."""
    names = items_of(items)
    lookups = F.array_join(F.transform(names, lambda n: F.concat(F.lit(f"- `{prefix}_api_lookup` on `\""), n, F.lit('"`'))), "\n")
    return F.concat(F.lit(f"## Compare in {title}: "), quoted(names), F.lit("\n\n"), lookups)


def migrate_prompt(old: Column, new: Column, title: str, prefix: str) -> Column:
    """V6: how to move from one pattern to another."""
    ask = lambda x: F.concat(F.lit(f"- `{prefix}_docs_search` with query `\""), x, F.lit('"`'))
    return F.concat(F.lit(f"## Migrate in {title}: "), old, F.lit(" → "), new, F.lit("\n\n"), ask(old), F.lit("\n"), ask(new))
