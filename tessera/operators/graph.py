"""Cross references: links, their targets, their kinds, and expansion by one hop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINK = r"\[([^\]]*)\]\(([^)\s]+)\)"
KINDS = ("high", "medium", "low")
#: Ranks from 0 up to which a hit's references of a kind are followed.
FOLLOWED = {"low": 5, "medium": 10}
MOST_TARGETS = 10


def links(text: Column) -> Column:
    """G1: array of (text, target) in order; images are links too."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)).alias("label"), F.regexp_extract_all(text, F.lit(LINK), F.lit(2)).alias("target"))


def normal_path(path: Column) -> Column:
    """``.`` and ``..`` taken out; ``..`` at the root does nothing."""

    def step(done: Column, part: Column) -> Column:
        kept = F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
        return F.when((part == ".") | (part == ""), done).when(part == "..", kept).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve(link: Column, source: Column) -> Column:
    """Path of a link in a file, with its anchor; null for other sites, mail and anchors of the same page."""
    path, anchor = F.split_part(link, F.lit("#"), F.lit(1)), F.regexp_extract(link, "(#.*)$", 1)
    folder = F.regexp_replace(source, "[^/]*$", "")
    full = (
        F.when(path.startswith("/"), F.regexp_replace(path, "^/+", ""))
        .when(path.startswith("."), normal_path(F.concat(folder, path)))
        .otherwise(F.concat(folder, path))
    )
    bare = F.regexp_replace(F.regexp_replace(full, r"\.(html|md)$", ""), "/+$", "")
    outside = link.rlike("^(https?:|mailto:|#)") | (link == "") | (bare == "")
    return F.when(~outside, F.concat(bare, anchor))


def classify(source: Column, target: Column, pairs: list[tuple[str, str]]) -> Column:
    """High for a listed pair of top folders, medium for the same two first segments, else low."""
    a, b = F.split_part(source, F.lit("/"), F.lit(1)), F.split_part(target, F.lit("/"), F.lit(1))
    listed = F.concat_ws("|", F.least(a, b), F.greatest(a, b)).isin([f"{min(p)}|{max(p)}" for p in pairs]) if pairs else F.lit(False)
    two = F.substring_index(F.regexp_replace(source, r"#.*$", ""), "/", 2) == F.substring_index(F.regexp_replace(target, r"#.*$", ""), "/", 2)
    return F.when(listed, "high").when(two, "medium").otherwise("low")


def references(chunks: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """source_chunk_id, target, label, kind, ord; of equal targets in a chunk the first. chunks: chunk_id, file_path, content."""
    rows = chunks.select("chunk_id", "file_path", F.posexplode(links(F.col("content"))).alias("ord", "link"))
    rows = rows.select("chunk_id", "ord", F.col("link.label").alias("label"), resolve(F.col("link.target"), F.col("file_path")).alias("target"), "file_path")
    rows = rows.filter("target is not null").withColumn("kind", classify(F.col("file_path"), F.col("target"), pairs))
    first = Window.partitionBy("chunk_id", "target").orderBy("ord")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").select(F.col("chunk_id").alias("source_chunk_id"), "target", "label", "kind", "ord")


def adjacency(edges: DataFrame) -> DataFrame:
    """Targets of each chunk in order."""
    rows = edges.groupBy("source_chunk_id").agg(F.array_sort(F.collect_list(F.struct("ord", "target"))).alias("t"))
    return rows.select("source_chunk_id", F.col("t.target").alias("targets"))


def targets(hits: DataFrame, edges: DataFrame, most: int = MOST_TARGETS, untyped: bool = False) -> DataFrame:
    """What the hits refer to: query, target, prio, n. hits: query, chunk_id, rank (from 1).

    References of unknown kind count as high. Best priority of each target; then those with an anchor; then the first seen.
    """
    kind = F.lit("high") if untyped else F.coalesce("kind", F.lit("high"))
    rows = hits.join(edges, hits["chunk_id"] == edges["source_chunk_id"]).withColumn("kind", kind)
    open_ = (F.col("kind") == "high") | ((F.col("kind") == "medium") & (F.col("rank") - 1 < FOLLOWED["medium"])) | ((F.col("kind") == "low") & (F.col("rank") - 1 < FOLLOWED["low"]))
    rows = rows.filter(open_).withColumn("prio", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1)
    best = rows.groupBy("query", "target").agg(F.min("prio").alias("prio"), F.min(F.struct("rank", "ord")).alias("seen"))
    order = Window.partitionBy("query").orderBy("prio", (~F.col("target").contains("#")).cast("int"), "seen", "target")
    return best.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).select("query", "target", "prio", "n")


def total_references(edges: DataFrame) -> DataFrame:
    """How many references there are in all, and from how many chunks."""
    return edges.agg(F.count("*").alias("references"), F.countDistinct("source_chunk_id").alias("chunks"))


def expand(hits: DataFrame, edges: DataFrame, chunks: DataFrame, most: int = MOST_TARGETS, untyped: bool = False) -> DataFrame:
    """Hits with the chunks they refer to, score 0, none twice. chunks: chunk_id, file_path, chunk_type."""
    wanted = targets(hits, edges, most, untyped)
    exact = wanted.filter(F.col("target").contains("#")).join(chunks, F.regexp_replace("target", "^.*/", "") == F.col("chunk_id"))
    pages = wanted.filter(~F.col("target").contains("#")).join(
        chunks.filter(F.col("chunk_type").isin("section", "subsection", "page_summary")), F.regexp_replace("file_path", r"\.md$", "") == F.col("target")
    )
    more = exact.select("query", "chunk_id").unionByName(pages.select("query", "chunk_id")).distinct()
    more = more.join(hits.select("query", "chunk_id"), ["query", "chunk_id"], "left_anti")
    return hits.select("query", "chunk_id", "score").unionByName(more.select("query", "chunk_id", F.lit(0.0).alias("score")))


def related(matched: DataFrame, entities: DataFrame) -> DataFrame:
    """Matched entities, then what they are related to, each once; a dash where the type is unknown. matched: query, name, ord."""
    own = matched.select("query", "name", F.lit(0).alias("hop"), F.struct(F.col("ord").alias("a"), F.lit(0).alias("b")).alias("seen"))
    near = matched.join(entities.select("name", "related"), "name").select("query", F.col("ord").alias("a"), F.posexplode("related").alias("b", "name"))
    near = near.select("query", "name", F.lit(1).alias("hop"), F.struct("a", "b").alias("seen"))
    first = own.unionByName(near).groupBy("query", "name").agg(F.min(F.struct("hop", "seen")).alias("at"))
    out = first.join(entities.select("name", "entity_type"), "name", "left")
    order = Window.partitionBy("query").orderBy("at", "name")
    return out.select("query", "name", F.col("at.hop").alias("hop"), F.coalesce("entity_type", F.lit("—")).alias("entity_type"), F.row_number().over(order).alias("n"))
