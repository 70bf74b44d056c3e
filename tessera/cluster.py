"""What jobs on a cluster share: the package on the executors, and tables in a folder that all of them see."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, for functions that run in Python there."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "tessera_core.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in (n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the one for checkpoints, else the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (found or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is no longer referred to, now and not when the driver's memory fills."""
    gc.collect()
    spark._jvm.System.gc()


def few(rows: DataFrame, most: int) -> DataFrame:
    """The rows, to be broadcast if they are counted to be at most ``most``, else to be joined by shuffle: sizes that Spark projects from files
    don't tell how many rows come of them."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows.hint("merge")


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of a small file dealt to tasks by a key, for work that takes long for each row; a table that comes in many tasks stays as it is."""
    spark = rows.sparkSession
    if rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return rows
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def dealt_to(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Workspace:
    """Tables under the shared folder that cut lineage; ``close`` deletes them all, so results are read before it."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.n = spark, path or f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", 0

    def keep(self, rows: DataFrame) -> DataFrame:
        self.n += 1
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{self.n}")

    def bucketed(self, rows: DataFrame, tasks: int, by: list[str], sort: str) -> DataFrame:
        """A table dealt by columns, sorted by one: grouping by more columns than these needs no shuffle. ``rows`` come dealt by them to so many tasks."""
        self.n += 1
        name = f"table_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("compression", "zstd").bucketBy(tasks, *by).sortBy(sort).option("path", f"{self.path}/{self.n}").saveAsTable(name)
        return self.spark.table(name)

    def close(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
