"""Ranks, running totals and order statistics over all rows, with no group in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.cluster import send_package

ACCURACY, BROADCAST_ROWS = 2000, 100_000


def _summed(places: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [0] * len(places)
        for batch in batches:
            columns = list(batch.columns)
            for i, place in enumerate(places):
                sums = before[i] + np.cumsum(batch.column(place).to_numpy(zero_copy_only=False).astype(np.int64))
                before[i] = int(sums[-1]) if len(sums) else before[i]
                columns[place] = pa.array(sums)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def running(rows: DataFrame, order: list, measures: dict[str, Column], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows with running totals of whole-number measures in an order, each row's own included; a measure of 1 makes ranks from 1.

    Rows are dealt by ranges of the order and summed up within each range; the ranges' totals, a row for each partition, give what is to be
    added. The order should end in a key that tells rows apart: rows that it doesn't tell apart are of one range and stand in any order.
    """
    send_package(rows.sparkSession)
    own = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({n: F.coalesce(m.cast("bigint"), F.lit(0)) for n, m in measures.items()})
    own = own.withColumn("__part", F.spark_partition_id())
    places = [own.columns.index(name) for name in measures]
    summed = keep(own.mapInArrow(_summed(places), T.StructType([T.StructField(f.name, f.dataType, True) for f in own.schema])))
    totals = summed.groupBy("__part").agg(*[F.max(name).alias(f"__{name}") for name in measures])  # a row for each partition; totals of what isn't negative
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    added = totals.select("__part", *[F.coalesce(F.sum(f"__{name}").over(before), F.lit(0)).alias(f"__{name}") for name in measures])
    out = summed.join(F.broadcast(added), "__part").withColumns({name: F.col(name) + F.col(f"__{name}") for name in measures})
    return out.select(*rows.columns, *[name for name in measures if name not in rows.columns])


def at_ranks(rows: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[float, Column]], keep: Callable[[DataFrame], DataFrame], accuracy: int = ACCURACY) -> DataFrame:
    """by, n (values of the group), and for each wanted name the value at a rank from 0. wanted: name to the share of the values that lie
    below, roughly, and the rank as a column of ``n``. Nulls don't count; a group without values has no row.

    Exact, in two passes. The first sketches each group and gives a range of values around each rank, of about ``4 / accuracy`` of the group. The
    second counts what lies below the range, and each different value inside; the value comes from running counts of these few. Both aggregate in
    each task first. A rank outside its range, which the sketch's bound rules out, is an error and not a wrong value.
    """
    own = rows.select(*by, F.col(value).alias("__v")).filter("__v is not null")
    eps = 2 / accuracy
    low = {w: F.min("__v") if f - eps <= 0 else F.percentile_approx("__v", f - eps, accuracy) for w, (f, _) in wanted.items()}
    high = {w: F.max("__v") if f + eps >= 1 else F.percentile_approx("__v", f + eps, accuracy) for w, (f, _) in wanted.items()}
    groups = own.groupBy(*by).agg(F.count("*").alias("n"), *[low[w].alias(f"__low_{w}") for w in wanted], *[high[w].alias(f"__high_{w}") for w in wanted])
    ranges = F.array(*[F.struct(F.lit(w).alias("wanted"), rank.cast("bigint").alias("rank"), F.col(f"__low_{w}").alias("low"), F.col(f"__high_{w}").alias("high")) for w, (_, rank) in wanted.items()])
    told = keep(groups.select(*by, "n", F.explode(ranges).alias("__r")).select(*by, "n", "__r.*"))
    small = told.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    named = [F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]
    side = told.select(*named, "n", "wanted", "rank", "low", "high")
    same = [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)]
    met = own.join(F.broadcast(side) if small else side, [*same, F.col("__v") <= F.col("high")])  # without ``by`` a row for each wanted rank
    counts = met.groupBy(*by, "wanted", "rank", F.when(F.col("__v") >= F.col("low"), F.col("__v")).alias("__inside")).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*by, "wanted").orderBy(F.asc_nulls_first("__inside")))
    reached = counts.withColumn("__upto", upto).filter(F.col("__upto") > F.col("rank"))
    first = reached.groupBy(*by, "wanted").agg(F.min_by(F.struct(F.col("__inside").alias("v")), "__upto").alias("__first"))
    missed = F.raise_error(F.lit("a rank lies outside its range")).cast(dict(own.dtypes)["__v"])
    found = first.select(*by, "wanted", F.when(F.col("__first.v").isNull(), missed).otherwise(F.col("__first.v")).alias("__v"))
    values = found.groupBy(*by).agg(*[F.max(F.when(F.col("wanted") == w, F.col("__v"))).alias(w) for w in wanted])
    sizes = told.select(*named, "n").distinct()
    out = sizes.join(values, same, "left") if by else sizes.join(values)  # a row each
    return out.select(*[F.col(f"__by{i}").alias(c) for i, c in enumerate(by)], "n", *wanted)


def middle() -> dict[str, tuple[float, Column]]:
    """What ``at_ranks`` needs for medians: the mean of the two is the median."""
    return {"lower": (0.5, F.floor((F.col("n") - 1) / 2)), "upper": (0.5, F.floor(F.col("n") / 2))}
