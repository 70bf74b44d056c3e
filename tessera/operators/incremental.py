"""Incremental indexing: changes, merges, deletions, state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(state: DataFrame, current: DataFrame, key: list[str], version: str = "version", content: str = "content_hash", full: bool = False) -> DataFrame:
    """Key and change: new, changed, unchanged or deleted. One full outer join."""
    old = state.select(*key, F.col(content).alias("__old"), F.col(version).alias("__old_version"), F.lit(True).alias("__was"))
    new = current.select(*key, F.col(content).alias("__new"), F.col(version).alias("__new_version"), F.lit(True).alias("__is"))
    both = old.join(new, key, "full_outer")
    same = F.col("__old").eqNullSafe(F.col("__new")) & F.col("__old_version").eqNullSafe(F.col("__new_version"))
    kind = F.when(F.col("__is").isNull(), "deleted").when(F.col("__was").isNull(), "new").when(F.lit(full) | ~same, "changed").otherwise("unchanged")
    return both.select(*key, kind.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """K3, K4, K6: new rows replace old ones of their key; of several new rows of a key the last by ``order`` stays."""
    if order is not None:
        last = Window.partitionBy(*key).orderBy(F.desc(order))
        new = new.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def delete(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """K7, I6."""
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def replace_source(rows: DataFrame, path: str, by: str = "source") -> None:
    """K1, K2: the sources that rows hold are written anew, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def file_state(chunks: DataFrame, by: list[str]) -> DataFrame:
    """I8: chunk ids of each file, in order."""
    return chunks.groupBy(*by).agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows that share a key, the last by order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


LEAVES = ("section", "subsection", "code_block", "image")
ERRORS = "parse_error"


class Run:
    """One incremental run over a source. state: path, content_hash, version, chunk_ids; current: path, content_hash.

    Everything is a DataFrame; nothing is done until it is asked for.
    """

    def __init__(self, state: DataFrame, current: DataFrame, version: str, full: bool = False):
        self.state, self.version = state, version
        self.changes = changes(state, current.withColumn("version", F.lit(version)), ["path"], full=full)
        self.current = current

    def _of(self, *kinds: str) -> DataFrame:
        return self.changes.filter(F.col("change").isin(*kinds)).select("path")

    @property
    def to_process(self) -> DataFrame:
        return self._of("new", "changed")

    @property
    def deleted(self) -> DataFrame:
        return self._of("deleted")

    @property
    def unchanged(self) -> DataFrame:
        return self._of("unchanged")

    def idle(self) -> bool:
        """I4: nothing to do."""
        return self.changes.filter(F.col("change") != "unchanged").isEmpty()

    def listing(self) -> DataFrame:
        """I4: what a dry run tells: a sign and a path."""
        sign = F.when(F.col("change") == "deleted", "-").otherwise("+")
        return self.changes.filter(F.col("change") != "unchanged").select(sign.alias("sign"), "path")

    def reloaded(self, stored: DataFrame) -> DataFrame:
        """Stored leaf chunks of unchanged files."""
        return stored.filter(F.col("chunk_type").isin(*LEAVES)).join(self.unchanged.withColumnRenamed("path", "file_path"), "file_path", "left_semi")

    def purged(self, stored: DataFrame) -> DataFrame:
        """Stored rows without those of changed and deleted files, and without any summary."""
        stale = self._of("changed", "deleted").withColumnRenamed("path", "file_path")
        return stored.filter(~F.col("chunk_type").endswith("_summary")).join(stale, "file_path", "left_anti")

    def next_state(self, chunks: DataFrame) -> DataFrame:
        """I8: the state after the run; chunks: those of processed files."""
        ids = chunks.select(F.col("file_path").alias("path"), "chunk_id").groupBy("path").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
        done = self.current.join(self.to_process, "path", "left_semi").select("path", "content_hash", F.lit(self.version).alias("version")).join(ids, "path", "left")
        done = done.withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))
        return self.state.join(self.unchanged, "path", "left_semi").select("path", "content_hash", "version", "chunk_ids").unionByName(done)


def parsed_or_raise(rows: DataFrame, error: str = ERRORS, path: str = "path") -> DataFrame:
    """The rows, if none holds an error; else all errors in one, by path."""
    bad = rows.filter(F.col(error).isNotNull()).groupBy().agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.concat_ws(": ", path, error))).alias("all")).first()
    if bad["n"]:
        raise ValueError(f"{bad['n']} files could not be read:\n" + "\n".join(bad["all"][:100]))
    return rows.drop(error)


class State:
    """What is known of indexed files: path, content_hash, version, chunk_ids."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def get(self, path: str):
        return self.rows.filter(F.col("path") == path).first()

    def put(self, more: DataFrame) -> State:
        return State(upsert(self.rows, more, ["path"]))

    def remove(self, gone: DataFrame) -> State:
        return State(delete(self.rows, gone, ["path"]))

    def paths(self) -> DataFrame:
        return self.rows.select("path")

    def total_chunks(self) -> DataFrame:
        """A3."""
        return self.rows.agg(F.coalesce(F.sum(F.size("chunk_ids")), F.lit(0)).cast("long").alias("chunks"))
