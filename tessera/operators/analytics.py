"""Listings, rollups, usage and retrieval-quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.cluster import Workspace
from tessera.operators import order

DIMENSIONS = ("relevance", "completeness", "correctness", "api_coverage", "conciseness")
THRESHOLDS = (5, 4, 3, 2)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def listing(pages: DataFrame, path: str = "path") -> DataFrame:
    """A1: sorted paths of each folder."""
    return pages.groupBy(folder_of(F.col(path)).alias("folder")).agg(F.array_sort(F.collect_list(path)).alias("paths"))


def ancestors(folder: Column) -> Column:
    """Every folder above, and the folder itself."""
    parts = F.split(folder, "/")
    return F.when(folder == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def scopes(pages: DataFrame, path: str = "path") -> DataFrame:
    """A5: pages in or below each folder."""
    rows = pages.select(path, F.explode(ancestors(folder_of(F.col(path)))).alias("scope"))
    return rows.groupBy("scope").agg(F.countDistinct(path).alias("pages"))


def p95(values: Column) -> Column:
    """Of the sorted values above 0 the one at the floor of 0.95 n, counted from 0.

    Exact and order-free: a percentile of the discrete kind at that position.
    """
    kept = F.array_sort(F.collect_list(F.when(values > 0, values)))
    return F.try_element_at(kept, F.floor(F.size(kept) * F.lit(0.95)).cast("int") + 1)


def p95_by(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """A12 for groups of any size: the value at the rank, selected in two passes, so that no group's values meet in one task."""
    keep = Workspace(rows.sparkSession).keep
    found = order.at_ranks(rows.filter(F.col(value) > 0), by, value, {"p95": (0.95, F.floor(F.col("n") * F.lit(0.95)))}, keep)
    return found.select(*by, "p95")


def recall(expected: Column, text: Column) -> Column:
    """A10: share of the expected strings that stand in a text in any case; 1 where none is expected."""
    hits = F.size(F.filter(expected, lambda x: F.instr(F.lower(text), F.lower(x)) > 0))
    return F.when(F.size(expected) == 0, 1.0).otherwise(hits / F.size(expected))


def path_hits(expected: Column, found: Column) -> tuple[Column, Column]:
    """How many found paths hold an expected one, and how many expected ones stand in a found one, in any case."""
    hits = F.size(F.filter(found, lambda x: F.exists(expected, lambda e: F.instr(F.lower(x), F.lower(e)) > 0)))
    return hits, F.size(F.filter(expected, lambda e: F.exists(found, lambda x: F.instr(F.lower(x), F.lower(e)) > 0)))


def rates(expected: Column, found: Column, hits: Column, covered: Column) -> tuple[Column, Column]:
    """Precision and F1 of such counts."""
    p = F.when(F.size(found) > 0, hits / F.size(found))
    r = F.when(F.size(expected) > 0, covered / F.size(expected))
    return p, F.when((p + r) > 0, 2 * p * r / (p + r))


def precision_f1(expected: Column, found: Column) -> tuple[Column, Column]:
    """A10: precision of found paths, and F1 with their recall; null without paths, or where both are 0."""
    return rates(expected, found, *path_hits(expected, found))


def group_stats(results: DataFrame, sets: list[str], dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Means and medians of the marks above 0, by each of ``sets`` and over all, in one pass of grouping sets."""
    marks = [F.when(F.col(d) > 0, F.col(d)) for d in dims]
    any_mark = sum(((F.col(d) > 0).cast("int") for d in dims), F.lit(0)) > 0
    own = results.withColumn("__composite", F.when(any_mark, sum((F.col(d) for d in dims), F.lit(0)) / len(dims)))
    out = own.groupingSets([[F.col(s)] for s in sets] + [[]], *[F.col(s) for s in sets])
    return out.agg(
        F.count("*").alias("n"), F.avg("__composite").alias("composite"),
        *[F.avg(m).alias(f"avg_{d}") for m, d in zip(marks, dims)], *[F.median(m).alias(f"median_{d}") for m, d in zip(marks, dims)],
    )


def pass_rates(results: DataFrame, dims: tuple[str, ...] = DIMENSIONS, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """Share of results at or above each threshold, by dimension and in all of them."""
    parts = [F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims]
    parts.append(F.struct(F.lit("all").alias("dimension"), F.least(*map(F.col, dims)).alias("value")))
    rows = results.select(F.explode(F.array(*parts)).alias("m")).select("m.dimension", "m.value", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return rows.groupBy("dimension", "threshold").agg(F.avg((F.col("value") >= F.col("threshold")).cast("double")).alias("rate"))


def judge_median(runs: DataFrame, by: list[str], dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Median of each dimension over the runs, 0 left out, cut to a whole number."""
    return runs.groupBy(*by).agg(*[F.median(F.when(F.col(d) > 0, F.col(d))).cast("int").alias(d) for d in dims])


def packed(rows: DataFrame, by_order: list[str], size: Column, most: int, by: list[str] | None = None) -> DataFrame:
    """Rows in order up to the first that would exceed ``most`` in all; ``running`` is the size up to and with each. Sizes are whole numbers from 1."""
    if not by:
        return order.running(rows, by_order, {"running": size}, Workspace(rows.sparkSession).keep).filter(F.col("running") <= most)
    w = Window.partitionBy(*by).orderBy(*by_order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(w)).filter(F.col("running") <= most)


def last_of_session(events: DataFrame, session: str, at: str, tie: str, most: int = 10) -> DataFrame:
    """V8: the last rows of each session."""
    w = Window.partitionBy(session).orderBy(F.desc(at), F.desc(tie))
    return events.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)


def latest(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """A2: the latest time in several tables; the epoch if all are empty."""
    union = None
    for rows, column in tables:
        own = rows.agg(F.max(column).alias("t"))
        union = own if union is None else union.unionByName(own)
    return union.agg(F.coalesce(F.max("t"), F.lit("1970-01-01").cast("timestamp")).alias("updated"))
