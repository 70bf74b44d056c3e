"""A facade over the operators: search, lookups and resources for batches of queries (V1-V9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import analytics, bm25, graph, match, reconstruct, reranking, resources, retrieval

RETRIEVED, LEAST_SCORE, MOST_QUERY_CHARS, MOST_RESULTS = 50, -0.5, 2000, 20


class Engine:
    """chunks: chunk_id, content, file_path, section_title, breadcrumb, global_sort_key, chunk_type, language_tag, folder_path, source and,
    for dense retrieval, vec; for questions, parent_chunk_id. entities: name, entity_type, page_path, section, related, source;
    mentions: name, chunk_id."""

    def __init__(self, chunks: DataFrame, entities: DataFrame, synonyms: DataFrame, edges: DataFrame | None = None, mentions: DataFrame | None = None):
        self.chunks, self.entities, self.synonyms, self.edges, self.mentions = chunks, entities, synonyms, edges, mentions
        self.model = bm25.Model().fit(chunks, "chunk_id", "content")

    def hits(self, queries: DataFrame, scope: str | None = None) -> DataFrame:
        """query, doc, score, rank of the fused legs; a query without a hit in the scope gets those of all chunks."""
        inside = self.chunks if scope is None else self.chunks.filter(retrieval.in_scope(F.col("folder_path"), F.lit(scope)))
        scores = self.model.scores(queries, "query", "text")
        scoped = scores if scope is None else scores.join(inside.select(F.col("chunk_id").alias("doc")), "doc", "left_semi")

        def fused(sparse: DataFrame, chunks: DataFrame) -> DataFrame:
            legs = [bm25.top(sparse, RETRIEVED)]
            if "vec" in chunks.columns and "qvec" in queries.columns:
                legs.append(retrieval.dense(queries.select("query", "qvec"), chunks.select(F.col("chunk_id").alias("doc"), "vec"), RETRIEVED))
            return retrieval.fuse(legs, RETRIEVED)

        found = fused(scoped, inside)
        return found if scope is None else retrieval.with_fallback(found, fused(scores, self.chunks))

    def search(self, queries: DataFrame, most: int = 3, score: Callable[[DataFrame], Column] | None = reranking.cover_score, scope: str | None = None) -> DataFrame:
        """V1: query, answer. queries: query, text and, for dense retrieval, qvec. ``score`` makes the reranker's column of hits with their chunks
        and the query's columns; where it gives null, or is None, the order of retrieval stays (K21). R6: a query of over 2000 characters is an error."""
        if not 1 <= most <= MOST_RESULTS:
            raise ValueError(f"results must be from 1 to {MOST_RESULTS}")
        too_long = F.raise_error(F.lit(f"a query has over {MOST_QUERY_CHARS} characters"))
        asked = queries.withColumn("text", F.when(F.length("text") > MOST_QUERY_CHARS, too_long).otherwise(F.col("text")))
        hits = self.hits(asked, scope)
        if "parent_chunk_id" in self.chunks.columns:
            typed = hits.join(self.chunks.select(F.col("chunk_id").alias("doc"), "chunk_type", "parent_chunk_id"), "doc").withColumnRenamed("doc", "chunk_id")
            hits = bm25.top(retrieval.resolve_questions(typed, self.chunks).withColumnRenamed("chunk_id", "doc"), RETRIEVED)
        if self.edges is not None:
            named = hits.select("query", F.col("doc").alias("chunk_id"), "score", "rank")
            more = graph.expand(named, self.edges, self.chunks).select("query", F.col("chunk_id").alias("doc"), "score")
            hits = bm25.top(more, 10 * RETRIEVED)
        full = hits.join(self.chunks.withColumnRenamed("chunk_id", "doc"), "doc").join(asked.select("query", "text", *[c for c in ("qvec",) if c in asked.columns]), "query")
        if score is not None:
            full = retrieval.rerank(full.drop("rank"), F.coalesce(score(full), F.col("score")), LEAST_SCORE)
        ordered = reconstruct.reading_order(full.withColumnRenamed("doc", "chunk_id"), most)
        nothing = F.concat(F.lit("No documentation found for: "), "text")
        return reconstruct.assemble(reconstruct.islands(ordered), asked, nothing).select("query", resources.capped(F.col("answer")).alias("answer"))

    def matched(self, queries: DataFrame) -> DataFrame:
        """query, name, ord: what queries name, in order of method and name."""
        found = match.match(queries, self.entities, self.synonyms)
        prio = F.array_position(F.array(*map(F.lit, match.PRIORITY)), F.col("source"))
        return found.select("query", "name", F.struct(prio.alias("prio"), F.col("name").alias("n")).alias("ord"))

    def api_lookup(self, queries: DataFrame, prefix: str = "ecosystem") -> DataFrame:
        """V2: query, answer: the entity of that name, else the first that matches. queries: query, text."""
        exact = match.lookup(queries, self.entities.select("name")).select("query", "name")
        rest = queries.join(exact.select("query"), "query", "left_anti")
        near = self.matched(rest).groupBy("query").agg(F.min_by("name", "ord").alias("name"))
        found = queries.select("query", F.col("text").alias("asked")).join(exact.unionByName(near), "query", "left")
        known = self.entities if self.mentions is None else resources.with_counts(self.entities, self.mentions)
        return resources.lookup_text(found.join(known if "chunks" in known.columns else known.withColumn("chunks", F.lit(0)), "name", "left"), prefix)

    def related(self, queries: DataFrame) -> DataFrame:
        """V3: what queries name, then what that is related to, in order."""
        return graph.related(self.matched(queries), self.entities)

    def entity_cards(self) -> DataFrame:
        """V5, A9."""
        known = self.entities.withColumn("chunks", F.lit(0)) if self.mentions is None else resources.with_counts(self.entities, self.mentions)
        return resources.entity_card(known)

    def for_sources(self, names: list[str]) -> Engine:
        """V4: the same engine over some sources."""
        own = lambda rows: rows.filter(F.col("source").isin(names)) if rows is not None and "source" in rows.columns else rows
        return Engine(own(self.chunks), own(self.entities), self.synonyms, self.edges, self.mentions)

    def pages(self) -> DataFrame:
        return self.chunks.select("source", F.col("file_path").alias("path")).distinct()

    def topics(self, source: str, title: str, section: str | None = None) -> DataFrame:
        """V5, A6."""
        return resources.contents(self.pages().filter(F.col("source") == source), source, title, section)

    def scopes(self) -> DataFrame:
        """V5, A5."""
        return analytics.scopes(self.pages().select("path").distinct())

    def addresses(self) -> DataFrame:
        """V7."""
        return resources.addresses(self.pages(), self.entities)

    def page(self, path: str) -> DataFrame:
        """V5, S17."""
        return self.chunks.filter(F.regexp_replace("file_path", r"\.md$", "") == path.removesuffix(".md"))
