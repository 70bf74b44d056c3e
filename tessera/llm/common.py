"""What the operators of this subpackage share: column picking, shipping, lineage cuts and text units."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 24 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, and bound Arrow batches by bytes, so that long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(), "tessera_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "tessera")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """The frame with its columns named by position, so that none clashes with another, and where the named ones are; toDF(*df.columns) gives the names back."""
    at = []
    for name in names:
        found = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not found:
            raise ValueError(f"no column {name} among {df.columns}")
        at.append(f"__c{found[0]}")
    return df.toDF(*[f"__c{i}" for i in range(len(df.columns))]), at


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Columns by exact name, else by name in any case; other columns may share those names in another case."""
    own, at = numbered(df, *names)
    return own.select(*[F.col(c).alias(n) for c, n in zip(at, names)])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a folder of this machine only where none is set and all runs on it, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written under the shared folder; they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{checkpoint_dir(spark)}/tessera-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        return out

    def release(self) -> None:
        """Let Spark delete the shuffle files of what is no longer referred to, now and not when the driver's memory fills."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete kept tables that no later one and no result is made of; what isn't kept is left alone."""
        for df in tables:
            if not hasattr(df, "_tessera_path"):
                continue
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fingerprint(column: Column) -> Column:
    """128 bits of a text, as two hashes; equal texts only are taken as equal."""
    return F.struct(F.xxhash64(column).alias("a"), F.xxhash64(F.concat(F.lit("\u0001"), column)).alias("b"))


#: Every byte that is no part of a word becomes a space, A-Z become a-z; bytes of other scripts belong to words.
WORD_BYTES = bytes(
    (c | 32) if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


#: A text has words if it has any of these.
WORD_CHARACTERS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def bytes_of(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def arrow_type(schema: str | T.StructType):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)
