"""Markdown structure: headings, sections, chunks, images.

Lines are walked by one higher-order aggregate for each file, so a file's structure costs no shuffle; sections are then
rows. Fences are honoured; underlined headings and indented code are not. Arrays are exploded with their empty ones, which go
afterwards: else Spark infers a filter on the array, makes it twice, and makes it in the few tasks of a small file before its rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import breadcrumb, content_hash, fence_languages, slug

MOST_CHARS, LEAST_PARENT = 3000, 100
IMAGE, STYLE = r"!\[(.*?)\]\((.*?)\)", r'<div class="(options|composition)-api"'


def headings(text: Column) -> Column:
    """Array of (level, title, slug, line from 0) of the headings outside fences."""
    start = F.struct(F.lit(False).alias("fence"), F.lit(0).alias("line"), F.array().cast("array<struct<level:int,raw:string,line:int>>").alias("out"))

    def step(state: Column, line: Column) -> Column:
        mark = line.rlike(r"^\s{0,3}(```|~~~)")
        level = F.length(F.regexp_extract(line, r"^ {0,3}(#{1,6})(?:\s|$)", 1))
        found = F.struct(level.cast("int").alias("level"), F.trim(F.regexp_replace(line, r"^ {0,3}#{1,6}\s*|\s+#+\s*$", "")).alias("raw"), state["line"].alias("line"))
        return F.struct(
            F.when(mark, ~state["fence"]).otherwise(state["fence"]).alias("fence"), (state["line"] + 1).alias("line"),
            F.when(~state["fence"] & ~mark & (level > 0), F.concat(state["out"], F.array(found))).otherwise(state["out"]).alias("out"),
        )

    found = F.aggregate(F.split(text, "\n"), start, step, lambda s: s["out"])
    return F.transform(found, lambda h: F.struct(h["level"].alias("level"), F.trim(F.regexp_replace(h["raw"], r"\{#[^}]+\}\s*$", "")).alias("title"), slug(h["raw"]).alias("slug"), h["line"].alias("line")))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")


def page_title(path: Column, found: Column) -> Column:
    """The first heading of level 1, else the file's name in words."""
    first = F.try_element_at(F.filter(found, lambda h: h["level"] == 1), F.lit(1))["title"]
    return F.coalesce(first, F.initcap(F.regexp_replace(stem(path), "[-_]", " ")))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines_between(lines: Column, begin: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, begin + 1, F.greatest(end - begin, F.lit(0))), "\n")


def chunks(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Sections and subsections of every file.

    A section runs from a heading of level 2 to the next; one over ``MOST_CHARS`` characters with headings of level 3 is cut at
    them, its introduction standing before each part, and is a chunk itself only if that introduction has ``LEAST_PARENT`` characters. A file
    without a heading of level 2 is one section.
    """
    rows = files.select(F.col(path).alias("file_path"), F.split(text, "\n").alias("lines"), headings(F.col(text)).alias("heads"))
    rows = rows.withColumn("title", page_title(F.col("file_path"), F.col("heads"))).withColumn("n", F.size("lines"))
    second = F.filter("heads", lambda h: h["level"] == 2)
    whole = F.array(F.struct(F.lit(2).alias("level"), F.col("title").alias("title"), slug(F.col("title")).alias("slug"), F.lit(0).alias("line")))
    rows = rows.withColumn("twos", F.when(F.size(second) > 0, second).otherwise(whole)).withColumn("none", F.size(second) == 0)
    rows = rows.select("*", F.posexplode_outer("twos").alias("at", "head"))
    end = F.coalesce(F.try_element_at("twos", F.col("at") + 2)["line"], F.col("n"))
    rows = rows.withColumn("end", end).withColumn("content", stripped(lines_between(F.col("lines"), F.col("head.line"), F.col("end"))))
    threes = F.filter("heads", lambda h: (h["level"] == 3) & (h["line"] > F.col("head.line")) & (h["line"] < F.col("end")))
    rows = rows.withColumn("threes", F.when((F.length("content") > MOST_CHARS) & ~F.col("none"), threes).otherwise(F.array().cast("array<struct<level:int,title:string,slug:string,line:int>>")))
    intro = stripped(lines_between(F.col("lines"), F.col("head.line"), F.coalesce(F.try_element_at("threes", F.lit(1))["line"], F.col("end"))))
    rows = rows.withColumn("intro", intro).withColumn("parent", F.concat(stem(F.col("file_path")), F.lit("#"), F.col("head.slug")))
    base = ["file_path", "title", F.col("head.title").alias("section_title"), "at"]
    siblings = F.array_except(F.transform("twos", lambda h: F.concat(stem(F.col("file_path")), F.lit("#"), h["slug"])), F.array("parent"))
    kids = F.transform("threes", lambda h: F.concat(stem(F.col("file_path")), F.lit("#"), h["slug"]))
    sections = rows.filter((F.size("threes") == 0) | (F.length("intro") >= LEAST_PARENT)).select(
        *base, F.lit("").alias("subsection_title"), F.lit("section").alias("chunk_type"), F.col("parent").alias("chunk_id"), F.lit("").alias("parent_chunk_id"),
        siblings.alias("sibling_chunk_ids"), kids.alias("child_chunk_ids"), F.when(F.size("threes") > 0, F.col("intro")).otherwise(F.col("content")).alias("content"), F.lit(-1).alias("sub"),
    )
    parts = rows.withColumn("kids", kids).select("*", F.posexplode_outer("threes").alias("sub", "three")).filter("sub is not null")
    stop = F.coalesce(F.try_element_at("threes", F.col("sub") + 2)["line"], F.col("end"))
    own_id = F.concat(stem(F.col("file_path")), F.lit("#"), F.col("three.slug"))
    body = stripped(lines_between(F.col("lines"), F.col("three.line"), stop))
    parts = parts.select(
        *base, F.col("three.title").alias("subsection_title"), F.lit("subsection").alias("chunk_type"), own_id.alias("chunk_id"), F.col("parent").alias("parent_chunk_id"),
        F.array_except("kids", F.array(own_id)).alias("sibling_chunk_ids"), F.array().cast("array<string>").alias("child_chunk_ids"), F.concat_ws("\n\n", "intro", body).alias("content"), "sub",
    )
    out = sections.unionByName(parts)
    folder = F.regexp_replace("file_path", r"/?[^/]*$", "")
    return out.select(
        "*", F.when(folder == "", ".").otherwise(folder).alias("folder_path"), breadcrumb(F.col("title"), F.col("section_title"), F.col("subsection_title")).alias("breadcrumb"),
        content_hash(F.col("content")).alias("content_hash"), fence_languages(F.col("content")).alias("language_tag"),
    )


def images(text: Column) -> Column:
    """Array of (alt, src, line from 0) outside fences."""
    start = F.struct(F.lit(False).alias("fence"), F.lit(0).alias("line"), F.array().cast("array<struct<alt:string,src:string,line:int>>").alias("out"))

    def step(state: Column, line: Column) -> Column:
        mark = line.rlike(r"^\s{0,3}(```|~~~)")
        pairs = F.arrays_zip(F.regexp_extract_all(line, F.lit(IMAGE), F.lit(1)).alias("alt"), F.regexp_extract_all(line, F.lit(IMAGE), F.lit(2)).alias("src"))
        found = F.transform(pairs, lambda p: F.struct(p["alt"].alias("alt"), p["src"].alias("src"), state["line"].alias("line")))
        return F.struct(
            F.when(mark, ~state["fence"]).otherwise(state["fence"]).alias("fence"), (state["line"] + 1).alias("line"),
            F.when(~state["fence"] & ~mark, F.concat(state["out"], found)).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(F.split(text, "\n"), start, step, lambda s: s["out"])


def image_chunks(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """A chunk for each image of a section of level 2: its mark, with up to two lines before and after as prose, hashed by its source."""
    rows = files.select(F.col(path).alias("file_path"), F.split(text, "\n").alias("lines"), headings(F.col(text)).alias("heads"), images(F.col(text)).alias("images"))
    rows = rows.withColumn("title", page_title(F.col("file_path"), F.col("heads"))).withColumn("twos", F.filter("heads", lambda h: h["level"] == 2))
    rows = rows.select("*", F.posexplode_outer("twos").alias("at", "head")).filter("at is not null").withColumn("end", F.coalesce(F.try_element_at("twos", F.col("at") + 2)["line"], F.size("lines")))
    inside = F.filter("images", lambda i: (i["line"] >= F.col("head.line")) & (i["line"] < F.col("end")))
    rows = rows.withColumn("section", F.concat(stem(F.col("file_path")), F.lit("#"), F.col("head.slug"))).select("*", F.posexplode_outer(inside).alias("n", "image")).filter("n is not null")
    context = lines_between(F.col("lines"), F.greatest(F.col("head.line"), F.col("image.line") - 2), F.least("end", F.col("image.line") + 3))
    return rows.select(
        "file_path", F.concat("section", F.lit("-img-"), F.col("n").cast("string")).alias("chunk_id"), F.lit("image").alias("chunk_type"), F.col("section").alias("parent_chunk_id"),
        F.concat(F.lit("!["), "image.alt", F.lit("]("), "image.src", F.lit(")")).alias("content"), stripped(context).alias("preceding_prose"),
        content_hash(F.col("image.src")).alias("content_hash"), breadcrumb(F.col("title"), F.col("head.title")).alias("breadcrumb"),
    )


def style_lines(text: Column) -> Column:
    """P10: for each line the innermost styled block it is in: ``options``, ``composition`` or, outside all, ``both``.

    A closing mark on a line of its own ends the innermost block.
    """
    strings = F.array().cast("array<string>")
    start = F.struct(strings.alias("open"), strings.alias("out"))

    def step(state: Column, line: Column) -> Column:
        opens = F.regexp_extract(line, STYLE, 1)
        closes = line.rlike(r"^\s*</div>\s*$") & (F.size(state["open"]) > 0)
        less = F.slice(state["open"], 1, F.greatest(F.size(state["open"]) - 1, F.lit(0)))
        stack = F.when(opens != "", F.concat(state["open"], F.array(opens))).when(closes, less).otherwise(state["open"])
        return F.struct(stack.alias("open"), F.concat(state["out"], F.array(F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit("both")))).alias("out"))

    return F.aggregate(F.split(text, "\n"), start, step, lambda s: s["out"])


def style_of(styles: Column) -> Column:
    """P10: the one style of some lines, ``both`` where there is none or more than one."""
    told = F.array_distinct(F.filter(styles, lambda s: s != "both"))
    return F.when(F.size(told) == 1, told[0]).otherwise("both")


def api_style(text: Column) -> Column:
    return style_of(style_lines(text))


def section_styles(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """P10: the style of each section of level 2."""
    rows = files.select(F.col(path).alias("file_path"), style_lines(F.col(text)).alias("styles"), F.filter(headings(F.col(text)), lambda h: h["level"] == 2).alias("twos"))
    rows = rows.select("*", F.posexplode_outer("twos").alias("at", "head")).filter("at is not null").withColumn("end", F.coalesce(F.try_element_at("twos", F.col("at") + 2)["line"], F.size("styles")))
    own = F.slice("styles", F.col("head.line") + 1, F.col("end") - F.col("head.line"))
    return rows.select("file_path", F.concat(stem(F.col("file_path")), F.lit("#"), F.col("head.slug")).alias("chunk_id"), style_of(own).alias("api_style"))
