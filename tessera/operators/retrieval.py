"""Dense and hybrid retrieval, filters and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.bm25 import top

BROADCAST_BYTES = 32 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def dense(queries: DataFrame, chunks: DataFrame, limit: int, where: Column | None = None, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Exact cosine top ``limit``. queries: query, qvec; chunks: doc, vec and what ``where`` reads, applied before ranking.

    Every query meets every chunk, queries in blocks of measured size that are broadcast; the best of each block's queries are found apart. Norms are computed once a row.
    """
    rows = (chunks if where is None else chunks.filter(where)).select("doc", "vec", norm(F.col("vec")).alias("n"))
    own = queries.select("query", "qvec", norm(F.col("qvec")).alias("qn"))
    size = own.agg(F.coalesce(F.sum(F.size("qvec") * 8), F.lit(0))).first()[0]
    blocks, out = max(1, -(-size // most_bytes)), None
    for i in range(blocks):
        block = own if blocks == 1 else own.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)
        scored = rows.join(F.broadcast(block), F.size("vec") == F.size("qvec"))
        found = top(scored.select("query", "doc", F.round(dot(F.col("qvec"), F.col("vec")) / (F.col("n") * F.col("qn")), 6).alias("score")), limit)
        out = found if out is None else out.unionByName(found)
    return out


def fuse(legs: list[DataFrame], limit: int, k: float = 2, base: int = 0) -> DataFrame:
    """Reciprocal rank fusion of ranked legs (query, doc, rank from 1): sum of 1 / (k + rank)."""
    parts = [leg.select("query", "doc", (1.0 / (k + F.col("rank") - 1 + base)).alias("part")) for leg in legs]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return top(union.groupBy("query", "doc").agg(F.round(F.sum("part"), 6).alias("score")), limit)


def with_fallback(scoped: DataFrame, whole: DataFrame) -> DataFrame:
    """Hits inside a scope; of all, for queries that have none there."""
    return scoped.unionByName(whole.join(scoped.select("query").distinct(), "query", "left_anti"))


def in_scope(folder: Column, scope: Column, exact: bool = False) -> Column:
    """The folder or what is below it."""
    return (folder == scope) if exact else ((folder == scope) | folder.startswith(F.concat(scope, F.lit("/"))))


def by_ids(chunks: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """R7."""
    return chunks.join(wanted.select(key).distinct(), key, "left_semi")


def by_paths(chunks: DataFrame, wanted: DataFrame, path: str, order: list[str], limit: int = 100, types: list[str] | None = None, type_column: str = "chunk_type") -> DataFrame:
    """Chunks of some files, at most ``limit`` in a stated order."""
    rows = chunks if types is None else chunks.filter(F.col(type_column).isin(types))
    return rows.join(wanted.select(path).distinct(), path, "left_semi").orderBy(*order).limit(limit)


def resolve_questions(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Question hits stand for their parents; a chunk keeps its best score; hits without a chunk go.

    hits: query, chunk_id, score, chunk_type, parent_chunk_id.
    """
    question = F.col("chunk_type") == "hype_question"
    target = F.when(question, F.nullif(F.col("parent_chunk_id"), F.lit(""))).otherwise(F.col("chunk_id"))
    best = hits.select("query", target.alias("chunk_id"), "score").filter("chunk_id is not null").groupBy("query", "chunk_id").agg(F.max("score").alias("score"))
    return best.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").select("query", "chunk_id", "score")


def rerank(hits: DataFrame, score: Column, least: float = -0.5) -> DataFrame:
    """Another score replaces the first one; hits under ``least`` go."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return hits.withColumn("score", score).filter(F.col("score") >= least).withColumn("rank", F.row_number().over(order))
