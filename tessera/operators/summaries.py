"""Enrichment and hierarchical summaries (N1-N7). Models are pluggable columns; the defaults need no network."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_QUESTIONS = 5


def first_sentences(text: Column, count: int = 2) -> Column:
    """An extract in place of a written summary."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0)), 1, count), "")


def hashed_embeddings(rows: DataFrame, key: str, tokens: Column, dim: int = 64) -> DataFrame:
    """Key, embedding, tokens: counts of tokens by hash, of length 1 (zeros without tokens), and how many there were; stands in for a model's vector.

    A text's tokens are counted apart before they are hashed, so a long text costs its distinct tokens.
    """
    words = rows.select(key, F.explode_outer(tokens).alias("token")).groupBy(key, "token").agg(F.count("token").alias("n"))
    slot = F.pmod(F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
    slots = words.select(key, slot.alias("slot"), "n").groupBy(key, "slot").agg(F.sum("n").alias("n"))
    found = slots.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "n")))).alias("m"), F.sum("n").alias("tokens"), F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    value = lambda i: F.when(F.col("norm") > 0, F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double") / F.col("norm")).otherwise(F.lit(0.0))
    return found.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value).alias("embedding"), "tokens")


ENRICHED = ("section", "subsection", "code_block")
MOST_FAILURES = 0.5


def prefixed(chunks: DataFrame, make: Callable[[Column], Column] = first_sentences, column: str = "contextual_prefix") -> DataFrame:
    """A prefix for chunks that have none and whose type, if told, is one of ``ENRICHED``."""
    old = F.col(column) if column in chunks.columns else F.lit(None).cast("string")
    takes = F.col("chunk_type").isin(*ENRICHED) if "chunk_type" in chunks.columns else F.lit(True)
    return chunks.withColumn(column, F.when((F.coalesce(old, F.lit("")) != "") | ~takes, old).otherwise(make(F.col("content"))))


def enriched_or_raise(attempted: DataFrame, error: str = "error", most: float = MOST_FAILURES) -> DataFrame:
    """The rows, unless more than half of them failed; error: null where a row didn't."""
    counts = attempted.agg(F.count("*").alias("n"), F.count(error).alias("bad")).first()
    if counts["n"] and counts["bad"] / counts["n"] > most:
        raise RuntimeError(f"{counts['bad']} of {counts['n']} chunks could not be enriched")
    return attempted


def questions(generated: Column, most: int = MOST_QUESTIONS) -> Column:
    """The first questions that aren't blank."""
    return F.slice(F.filter(generated, lambda q: F.trim(q) != ""), 1, most)


def question_rows(chunks: DataFrame) -> DataFrame:
    """A row for each question, with its parent; ids don't depend on the batch."""
    rows = chunks.select("chunk_id", F.posexplode("hype_questions").alias("i", "content"))
    return rows.select(F.concat("chunk_id", F.lit("#hype#"), F.col("i").cast("string")).alias("chunk_id"), F.col("chunk_id").alias("parent_chunk_id"), "content", F.lit("hype_question").alias("chunk_type"))


def roll_up(rows: DataFrame, by: Column, name: str, title: str, text: str, key: str, entities: str, kind: str, summarise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One summary for each group: ``**title:** text`` of its rows in key order, the union of entities, the first key.

    A group is as large as a folder's pages; rows of the files of one folder meet in one array.
    """
    own = rows.groupBy(by.alias(name)).agg(
        F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(title).alias("t"), F.col(text).alias("x")))).alias("rows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(entities)))).alias("api_entities"), F.min(key).alias("global_sort_key"),
    )
    joined = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("**"), r["t"], F.lit(":** "), r["x"])), "\n\n")
    content = joined if summarise is None else summarise(joined)
    return own.select(name, F.concat(F.col(name), F.lit("#" + kind)).alias("chunk_id"), content.alias("content"), "api_entities", "global_sort_key", F.lit(kind).alias("chunk_type"))
