"""A corpus pipeline: quality, near-duplicates, contamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, orderminhash, packing, quality, surrogates
from tessera.llm.common import Scratch

SURROGATE_KEY = "tessera"

#: No SQL: the classifier's scores and the tokenizer's ids can't be had in it. Tested stage by stage against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, takes for good."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, into="__score").filter(F.col("__score") >= 0.5).drop("__score")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return orderminhash.keep_one(docs)


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark windows in a twentieth of their words or more."""
    found = decontaminate.search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into="__found")
    return found.filter(~decontaminate.contaminated("__found")).drop("__found")


def surrogate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data, and n_chars told anew where there were any."""
    out = surrogates.replace(docs, SURROGATE_KEY, found="__found")
    if "n_chars" in docs.columns:
        size = F.when(F.col("__found").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", size)
    return out.drop("__found")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.digests(packing.pack(docs, packing.vocabulary_path()))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", contamination_stage),
    ("PII", surrogate_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's result written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
