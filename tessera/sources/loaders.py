"""Dictionaries and questions as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "entity_type string, page_path string, section string, related array<string>, source string"
QUESTION = "question string, framework string, intent string, difficulty string, expected_answer string, relevant_paths array<string>, relevant_apis array<string>"


def entities_of(json: Column) -> Column:
    """Entries (key, value) of a JSON object of entities by name."""
    return F.map_entries(F.from_json(json, f"map<string, struct<{', '.join(f.strip().replace(' ', ':', 1) for f in ENTITY.split(','))}>>"))


def load_dictionary(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Name and the fields of an entity. lines: each line is an object of its own, as ``save_dictionary`` writes them."""
    whole = spark.read.text(path, wholetext=not lines)
    return whole.select(F.explode(entities_of(F.col("value"))).alias("e")).select(F.col("e.key").alias("name"), "e.value.*")


def save_dictionary(entities: DataFrame, path: str) -> None:
    """One JSON object for each entity, a line each."""
    fields = [f.strip().split(" ")[0] for f in ENTITY.split(",")]
    own = entities.select(F.to_json(F.map_from_arrays(F.array("name"), F.array(F.struct(*fields)))).alias("value"))
    own.write.mode("overwrite").text(path)


def load_questions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The questions of several JSON arrays; a missing file is an error."""
    return spark.read.schema(QUESTION).option("multiLine", True).option("mode", "FAILFAST").json(paths)
