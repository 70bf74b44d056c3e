"""What is stored of chunks, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields that are stored of a chunk, their types, and what a missing one counts as; without that, it must be there.
FIELDS = {
    "source": ("string", None), "file_path": ("string", None), "folder_path": ("string", None), "page_title": ("string", None), "section_title": ("string", None),
    "subsection_title": ("string", "''"), "breadcrumb": ("string", None), "global_sort_key": ("string", None), "chunk_type": ("string", None), "content_type": ("string", "'text'"),
    "language_tag": ("string", "''"), "api_style": ("string", "'both'"), "api_entities": ("array<string>", "array()"), "cross_references": ("array<string>", "array()"),
    "parent_chunk_id": ("string", "''"), "sibling_chunk_ids": ("array<string>", "array()"), "child_chunk_ids": ("array<string>", "array()"), "preceding_prose": ("string", "''"),
    "content": ("string", None), "contextual_prefix": ("string", "''"), "content_hash": ("string", "''"),
}
#: Of a question's payload, what isn't its parent's.
OF_QUESTIONS = {
    "chunk_type": "'hype_question'", "content_type": "'text'", "language_tag": "''", "cross_references": "array()", "sibling_chunk_ids": "array()", "child_chunk_ids": "array()",
    "preceding_prose": "''", "contextual_prefix": "''", "content_hash": "''",
}


def schema() -> str:
    return "chunk_id string, " + ", ".join(f"{name} {kind}" for name, (kind, _) in FIELDS.items())


def create(spark: SparkSession, path: str, anew: bool = False) -> None:
    """K8: an empty collection; one that is there stays unless it is wanted anew."""
    spark.createDataFrame([], schema()).write.mode("overwrite" if anew else "ignore").parquet(path)


def payload(chunks: DataFrame) -> DataFrame:
    """K9: chunk_id and the stored fields, missing ones filled."""
    columns = []
    for name, (kind, default) in FIELDS.items():
        own = F.col(name).cast(kind) if name in chunks.columns else F.lit(None).cast(kind)
        columns.append((own if default is None else F.coalesce(own, F.expr(f"cast({default} as {kind})"))).alias(name))
    return chunks.select("chunk_id", *columns)


def chunks_of(stored: DataFrame) -> DataFrame:
    """Chunks from stored rows; a null in a field that must be there is an error."""
    filled = payload(stored)
    needed = ["chunk_id", *[n for n, (_, default) in FIELDS.items() if default is None]]
    return filled.select(*[F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a stored chunk has no {c}"))).otherwise(F.col(c)).alias(c) if c in needed else F.col(c) for c in filled.columns])


def question_payload(chunks: DataFrame, questions: str = "hype_questions") -> DataFrame:
    """A stored row for each question of a chunk; it has its parent's place, and no lists but the names of its entities."""
    rows = payload(chunks).join(chunks.select("chunk_id", F.posexplode(questions).alias("__i", "__question")), "chunk_id")
    for name, value in OF_QUESTIONS.items():
        rows = rows.withColumn(name, F.expr(f"cast({value} as {FIELDS[name][0]})"))
    rows = rows.withColumn("parent_chunk_id", F.col("chunk_id")).withColumn("content", F.col("__question"))
    return rows.withColumn("chunk_id", F.concat("chunk_id", F.lit("#hype#"), F.col("__i").cast("string"))).select("chunk_id", *FIELDS)


def replaced(old: DataFrame, new: DataFrame, by: str = "source") -> DataFrame:
    """K1, K2: rows of the sources that ``new`` holds are its own."""
    return old.join(new.select(by).distinct(), by, "left_anti").select(*old.columns).unionByName(new)


def collection_stats(stored: DataFrame) -> DataFrame:
    """Rows in all and whether there are any."""
    return stored.agg(F.count("*").alias("points")).select("points", F.when(F.col("points") > 0, "green").otherwise("empty").alias("status"))
