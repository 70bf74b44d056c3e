"""Usage events as a stream (K12, V8 and windowed counts with late rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.cluster import shared_folder  # noqa: F401


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed(events: DataFrame, at: str = "ts", kind: str = "event_type", value: str = "value", late: str = "1 day", size: str = "1 day") -> DataFrame:
    """Counts and sums of each kind in windows of time; rows later than ``late`` are left out."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, size), kind)
    return rows.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def append(events: DataFrame, path: str, checkpoint: str):
    """Every event once, in a table that is only added to."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def on_change(spark: SparkSession, folder: str, schema, checkpoint: str, act):
    """Act on what is new since the last call."""
    stream = read_events(spark, folder, schema)
    return stream.writeStream.foreachBatch(lambda rows, _: act(rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
