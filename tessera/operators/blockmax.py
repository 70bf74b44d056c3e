"""Sparse top-k over postings in blocks that know their greatest weight.

Documents are dealt to blocks of about ``PER_BLOCK``, those of a like greatest weight together, so that a block of long documents has low
bounds. A row of the index is one token in one block: the greatest weight there, and the postings as an array. A search goes

1. a query's bound in a block is the sum of its tokens' greatest weights there; only tokens, blocks and weights are read;
2. the postings of the ``FIRST`` blocks with the highest bounds give each query a k-th score;
3. blocks whose bound doesn't reach it hold no document of the first k; the postings of the others are read and summed.

Results are those of summing all postings: a bound is never below a score, and ties at the last place are read as well. The index is dealt
by blocks, so that a document's score is whole in one task, and documents are shuffled to it with their postings in one row. Queries'
tokens are broadcast where they are few; bounds and scores are then made without a shuffle, and only the first of each task are sent on. Else
a token in very many documents has many rows, and both sides are salted, as many salts as its blocks ask for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.cluster import dealt_to, few, release
from tessera.operators.bm25 import top

PER_BLOCK, FIRST, BROADCAST_ROWS, SALT_ROWS = 4, 16, 200_000, 200_000
PER_TASK = 5000  # documents whose postings one task sorts
#: Scores are rounded to six digits; a bound this far below may still be rounded up to one.
SLACK = 2e-6
BLOCK = ["level", "block"]


class Index:
    """token, level, block, bound, n, postings (doc, weight)."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @classmethod
    def build(cls, postings: DataFrame, keep, per_block: int = PER_BLOCK) -> Index:
        """postings: doc, token, weight. Kept as a table, sorted by token; before that as a table of documents with their postings, so that the
        postings are made once and dealt to blocks in the row of their document."""
        postings = keep(postings)
        release(postings.sparkSession)
        own = F.collect_list(F.struct("token", "weight")).alias("own")
        docs = keep(postings.groupBy("doc").agg(own, F.max("weight").alias("most")))
        release(postings.sparkSession)
        return cls.of(docs, F.col("own"), lambda rows, _: keep(rows.sortWithinPartitions("token")), per_block)

    @classmethod
    def of(cls, docs: DataFrame, own: Column, keep, per_block: int = PER_BLOCK) -> Index:
        """docs: doc, most (its greatest weight) and the columns of which ``own`` makes its postings (token, weight), once they are dealt; a row for each
        document. ``keep`` makes a table of rows that come dealt by block to so many tasks."""
        level = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(8 * F.log2(1 + F.col("most"))))).cast("int")
        docs = docs.withColumn("level", level)
        sizes = docs.groupBy("level").agg(F.count("*").alias("n"))  # 256 rows at most
        tasks = max(dealt_to(docs.sparkSession), -(-sum(r["n"] for r in sizes.collect()) // PER_TASK))
        sizes = sizes.select("level", F.ceil(F.col("n") / per_block).alias("blocks"))
        placed = docs.join(F.broadcast(sizes), "level").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks"))).drop("blocks", "most")
        dealt = placed.repartition(tasks, *BLOCK).select("doc", *BLOCK, F.inline(own)).groupBy("token", *BLOCK)
        return cls(keep(dealt.agg(F.max("weight").alias("bound"), F.count("*").alias("n"), F.collect_list(F.struct("doc", "weight")).alias("postings")), tasks))

    @staticmethod
    def _few(asked: DataFrame) -> bool:
        return asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def _met(self, asked: DataFrame, *columns: str) -> DataFrame:
        """Tokens of queries with their rows of the index."""
        rows = self.rows.select("token", *BLOCK, *columns)
        if self._few(asked):
            return rows.join(F.broadcast(asked), "token")
        most = self.rows.groupBy("token").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        salts = -(-most // SALT_ROWS) or 1
        salted = asked.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return rows.withColumn("__salt", F.pmod(F.xxhash64(*BLOCK), F.lit(salts)).cast("int")).join(salted, ["token", "__salt"]).drop("__salt")

    def bounds(self, asked: DataFrame) -> DataFrame:
        """query, level, block, bound. asked: the different tokens of each query."""
        return self._met(asked, "bound").groupBy(*BLOCK, "query").agg(F.sum("bound").alias("bound"))

    def _scores(self, asked: DataFrame, blocks: DataFrame, allowed: DataFrame | None) -> DataFrame:
        wanted = few(blocks.select("query", *BLOCK).join(asked, "query"), BROADCAST_ROWS)
        return self._summed(self.rows.select("token", *BLOCK, "postings").join(wanted, ["token", *BLOCK]), allowed)

    @staticmethod
    def _summed(met: DataFrame, allowed: DataFrame | None) -> DataFrame:
        """Scores of documents, each of which is in one block."""
        rows = met.select("query", *BLOCK, F.inline("postings"))
        if allowed is not None:
            rows = rows.join(allowed.select("doc").distinct(), "doc", "left_semi")
        return rows.groupBy(*BLOCK, "query", "doc").agg(F.round(F.sum("weight"), 6).alias("score")).select("query", "doc", "score")

    def survivors(self, asked: DataFrame, limit: int, allowed: DataFrame | None = None, first: int = FIRST) -> DataFrame:
        """query, level, block: blocks that may hold one of the query's first ``limit``."""
        bounds = self.bounds(asked)
        return self._reached(bounds, self._least(bounds, asked, limit, allowed, first)).select("query", *BLOCK)

    def _least(self, bounds: DataFrame, asked: DataFrame, limit: int, allowed: DataFrame | None, first: int) -> DataFrame:
        """query, least: the last of the first ``limit`` scores in the blocks with the highest bounds, if there are so many."""
        order = Window.partitionBy("query").orderBy(F.desc("bound"), *BLOCK)
        high = bounds.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= first)
        least = top(self._scores(asked, high, allowed), limit).groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        return least.filter(F.col("n") == limit).select("query", "least")

    @staticmethod
    def _reached(rows: DataFrame, least: DataFrame) -> DataFrame:
        return rows.join(least, "query", "left").filter(F.col("bound") >= F.coalesce(F.col("least"), F.lit(0.0)) - SLACK)

    def search(self, asked: DataFrame, limit: int, allowed: DataFrame | None = None, first: int = FIRST) -> DataFrame:
        """query, doc, score, rank. allowed: the docs that may be found."""
        if not self._few(asked):
            return top(self._scores(asked, self.survivors(asked, limit, allowed, first), allowed), limit)
        met, least = self._met(asked, "bound", "postings"), self._least(self.bounds(asked), asked, limit, allowed, first)
        met = met.withColumn("bound", F.sum("bound").over(Window.partitionBy(*BLOCK, "query")))
        return top(self._summed(self._reached(met, F.broadcast(least)), allowed), limit)

    def read(self, asked: DataFrame, limit: int, first: int = FIRST) -> tuple[int, int]:
        """Postings that the last step reads, and those that queries' tokens have in all."""
        met = self._met(asked, "n")
        kept = met.join(self.survivors(asked, limit, None, first), ["query", *BLOCK], "left_semi")
        return tuple(rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for rows in (kept, met))
