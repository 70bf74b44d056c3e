"""Answers from hits: reading order, merging, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import page_url
from tessera.sources.markdown import CORE, base_url, display_name

LAST_KEY, SEPARATOR, NOTHING, MOST_REFERENCES = "zzz", "\n---\n\n", "No results found.", 5
SUMMARIES = ("folder_summary", "top_summary")
# What a summary is called, by kind.
SUMMARY_LABELS = {"page_summary": "Overview", "folder_summary": "Section Overview", "top_summary": "Topic Overview"}
#: What rendering reads of a hit, with what a missing column counts as.
RENDERED = {
    "content": "''", "section_title": "''", "subsection_title": "''", "language_tag": "''", "preceding_prose": "''", "image_url": "''", "breadcrumb": "''", "page_title": "file_path",
    "source": f"'{CORE}'", "api_entities": "cast(array() as array<string>)", "cross_references": "cast(array() as array<string>)",
}


def reading_order(hits: DataFrame, most: int) -> DataFrame:
    """The best hits of each query, summaries of folders first, then by sort key; ``pos`` counts from 1.

    hits: query, chunk_id, rank, chunk_type, global_sort_key, file_path, section_title and what is rendered.
    """
    order = Window.partitionBy("query").orderBy((~F.col("chunk_type").isin(*SUMMARIES)).cast("int"), F.coalesce("global_sort_key", F.lit(LAST_KEY)), "rank")
    return hits.filter(F.col("rank") <= most).withColumn("pos", F.row_number().over(order))


def adjacent(key: Column, before: Column) -> Column:
    """Same key but for the trailing number, which differs by one."""
    stem, number = F.regexp_replace(key, r"\d+$", ""), F.regexp_extract(key, r"(\d+)$", 1).try_cast("bigint")
    stem0, number0 = F.regexp_replace(before, r"\d+$", ""), F.regexp_extract(before, r"(\d+)$", 1).try_cast("bigint")
    return F.coalesce((stem == stem0) & (F.abs(number - number0) == 1), F.lit(False))


def islands(ordered: DataFrame) -> DataFrame:
    """``page_run`` counts runs of one file, ``merged`` runs of adjacent chunks of one section; ``pos`` is told anew.

    A summary of folders is a run of its own. Page summaries come first in their run, and none merges with anything.
    """
    w = Window.partitionBy("query").orderBy("pos")
    high = F.col("chunk_type").isin(*SUMMARIES)
    new_page = F.coalesce((F.col("file_path") != F.lag("file_path").over(w)) | high | F.lag(high).over(w), F.lit(True)).cast("int")
    runs = ordered.withColumn("__p", new_page).withColumn("page_run", F.sum("__p").over(w)).drop("__p")
    alone = F.col("chunk_type").endswith("_summary")
    runs = runs.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy("page_run", (~alone).cast("int"), "pos")))
    run, section, key = F.lag("page_run").over(w), F.lag("section_title").over(w), F.lag("global_sort_key").over(w)
    same = (F.col("page_run") == run) & ~alone & ~F.lag(alone).over(w) & F.col("section_title").eqNullSafe(section) & adjacent(F.col("global_sort_key"), key)
    marked = runs.withColumn("__g", (~F.coalesce(same, F.lit(False))).cast("int"))
    return marked.withColumn("merged", F.sum("__g").over(w)).drop("__g")


def filled(rows: DataFrame) -> DataFrame:
    """Rows with every column that rendering reads."""
    for name, default in RENDERED.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.expr(default)) if name in rows.columns else F.expr(default))
    return rows


def reference_link(reference: Column, source: Column) -> Column:
    """A file as a named link, anything else as it is."""
    name = F.initcap(F.replace(F.regexp_replace(reference, r"^.*/|\.md$", ""), F.lit("-"), F.lit(" ")))
    return F.when(reference.endswith(".md"), F.concat(F.lit("["), name, F.lit("]("), page_url(reference, base_url(source)), F.lit(")"))).otherwise(reference)


def front_matter(first: Column, apis: Column, references: Column) -> Column:
    """What is known of a group: first is its first hit, apis and references those of all of them in order, each once."""
    source = first["source"]
    links = F.transform(F.slice(references, 1, MOST_REFERENCES), lambda r: reference_link(r, source))
    lines = (
        F.lit("---"),
        F.when(first["breadcrumb"] != "", F.concat(F.lit("breadcrumb: "), first["breadcrumb"])),
        F.when((source != CORE) & (display_name(source) != ""), F.concat(F.lit("framework: "), display_name(source))),
        F.when(first["file_path"] != "", F.concat(F.lit("source: "), page_url(first["file_path"], base_url(source)))),
        F.when(F.size(apis) > 0, F.concat(F.lit("apis: ["), F.array_join(apis, ", "), F.lit("]"))),
        F.when(F.size(links) > 0, F.concat(F.lit("see_also: ["), F.array_join(links, ", "), F.lit("]"))),
        F.lit("---"),
    )
    return F.concat_ws("\n", *lines)


def rendered(hit: Column, heading: Column) -> Column:
    """One hit as lines of text, the last of them empty. heading: whether its title is shown."""
    kind, content, prose = hit["chunk_type"], hit["content"], hit["preceding_prose"]
    named = F.element_at(F.create_map(*[F.lit(x) for item in SUMMARY_LABELS.items() for x in item]), kind)
    title = F.when(hit["subsection_title"] != "", hit["subsection_title"]).otherwise(hit["section_title"])
    top = F.when(heading & (title != ""), F.concat(F.lit("### "), title, F.lit("\n\n"))).otherwise("")
    alt = F.when(content != "", content).otherwise("documentation image")
    image = F.when(hit["image_url"] != "", F.concat(F.lit("!["), alt, F.lit("]("), hit["image_url"], F.lit(")"))).otherwise(F.concat(F.lit("*[Image: "), alt, F.lit("]*")))
    return (
        F.when(named.isNotNull(), F.concat(F.lit("> [!NOTE]\n> **"), named, F.lit(":** "), content, F.lit("\n")))
        .when(kind == "code_block", F.concat(top, F.when(prose != "", F.concat(prose, F.lit("\n\n"))).otherwise(""), F.lit("```"), hit["language_tag"], F.lit("\n"), content, F.lit("\n```\n")))
        .when(kind == "image", F.concat(top, image, F.when(prose != "", F.concat(F.lit("\n\n"), prose)).otherwise(""), F.lit("\n")))
        .otherwise(F.concat(top, content, F.lit("\n")))
    )


def assemble(marked: DataFrame, queries: DataFrame, nothing: Column | None = None) -> DataFrame:
    """Query, answer: the runs of each query in order, separated by rules; each page under its title and address, each
    merged group under its front matter. marked: as ``islands`` gives it; a query has at most as many rows as results were asked for."""
    own = filled(marked)
    hit = F.struct("pos", "chunk_type", "file_path", *RENDERED)
    groups = own.groupBy("query", "page_run", "merged").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    together = lambda c: F.array_distinct(F.flatten(F.transform("hits", lambda h: h[c])))
    parts = F.transform("hits", lambda h, i: rendered(h, i == 0))
    text = F.concat(front_matter(F.col("hits")[0], together("api_entities"), together("cross_references")), F.lit("\n\n"), F.array_join(parts, "\n"))
    groups = groups.select("query", "page_run", F.struct(F.col("hits")[0]["pos"].alias("pos"), text.alias("text")).alias("g"), F.col("hits")[0].alias("first"))
    runs = groups.groupBy("query", "page_run").agg(F.array_sort(F.collect_list("g")).alias("g"), F.min_by("first", "first.pos").alias("first"))
    high = F.col("first.chunk_type").isin(*SUMMARIES)
    head = F.concat(F.lit("## "), F.col("first.page_title"), F.lit("\n<sup>[source]("), page_url(F.col("first.file_path"), base_url(F.col("first.source"))), F.lit(")</sup>\n\n"))
    section = F.concat(F.when(high, "").otherwise(head), F.array_join(F.transform("g", lambda g: g["text"]), "\n"))
    runs = runs.select("query", F.struct("page_run", section.alias("text")).alias("r"))
    answers = runs.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["text"]), SEPARATOR).alias("answer"))
    told = F.lit(NOTHING) if nothing is None else nothing
    return queries.dropDuplicates(["query"]).join(answers, "query", "left").select("query", F.coalesce("answer", told).alias("answer"))
