"""A stored collection in snapshots (K3, K4, K6-K8).

A collection is a folder of parts and manifests. A part is a table in buckets by point id; the first holds the collection, later ones what was put in or
taken out since. A manifest names the parts of one version and is written under its number by a rename that fails if the number is taken, so that readers
see one version or the next, never a mix, a failed write leaves the last version as it was, and of two writers one is told to try again.

Putting and removing shuffle the new rows only, into the buckets' number. Reading takes each part's rows without those that a later part holds: joins by id
between tables in equal buckets, which Spark makes without a shuffle. After ``MOST_PARTS`` parts, or when asked, they are written as one, bucket by bucket.
Parts that no manifest within ``KEPT`` versions names are deleted by ``clean``; a reader that started on one has to be done by then.

Ids are distinct in a version: of new rows with equal ids the greatest by ``order`` stays, or any if there is none. Rows without an id can't be stored.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, MOST_PARTS, KEPT = 64, 5, 2
GONE = "__gone"


class Conflict(RuntimeError):
    """Another writer was first."""


class Collection:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._at = lambda *names: hadoop.Path("/".join((self.path, *names)))

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str | T.StructType, key: str, buckets: int = BUCKETS) -> Collection:
        """K8: an empty collection; one that is there stays as it is."""
        out = cls(spark, path)
        if out.version() is None:
            fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
            out._publish(0, {"key": key, "buckets": buckets, "schema": fields.jsonValue(), "parts": []})
        return out

    # manifests

    def _numbers(self) -> list[int]:
        folder = self._at("manifests")
        return sorted(int(f.getPath().getName().split(".")[0]) for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".json")) if self._fs.exists(folder) else []

    def version(self) -> int | None:
        return max(self._numbers(), default=None)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version is None:
            raise FileNotFoundError(f"no collection in {self.path}")
        stream = self._fs.open(self._at("manifests", f"{version:09d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"version": version}

    def _publish(self, version: int, manifest: dict) -> None:
        draft, final = self._at("manifests", f".{uuid.uuid4().hex}"), self._at("manifests", f"{version:09d}.json")
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps({k: v for k, v in manifest.items() if k != "version"}), "utf-8"))
        stream.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            context.rename(draft, final, options)  # not over a file that is there
        except Exception as error:
            self._fs.delete(draft, False)
            raise Conflict(f"version {version} was written by another") from error

    # parts

    def _table(self, name: str, manifest: dict) -> DataFrame:
        """A part as a table in buckets, under a name of this session."""
        table = f"part_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.path}/{name}').hex}"
        if not self.spark.catalog.tableExists(table):
            fields = T.StructType.fromJson(manifest["schema"]).add(GONE, "boolean")
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
            by = f"CLUSTERED BY (`{manifest['key']}`) SORTED BY (`{manifest['key']}`) INTO {manifest['buckets']} BUCKETS"
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet {by} LOCATION '{self.path}/parts/{name}'")
        return self.spark.table(table)

    def _write(self, rows: DataFrame, manifest: dict, dealt: bool) -> str:
        """A part of rows with their mark; ``dealt``: they already stand bucket by bucket."""
        name, key = uuid.uuid4().hex, manifest["key"]
        own = rows if dealt else rows.repartition(manifest["buckets"], key)
        table = f"new_{name}"
        own.write.format("parquet").bucketBy(manifest["buckets"], key).sortBy(key).option("path", f"{self.path}/parts/{name}").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the name only; its files stay
        return name

    def _newest(self, manifest: dict) -> DataFrame:
        parts = [self._table(name, manifest) for name in manifest["parts"]]
        fields = T.StructType.fromJson(manifest["schema"]).add(GONE, "boolean")
        out = None
        for i, part in enumerate(parts):
            for later in parts[i + 1 :]:
                part = part.join(later.select(manifest["key"]), manifest["key"], "left_anti")
            own = part.filter(~F.col(GONE))
            out = own if out is None else out.unionByName(own)
        return self.spark.createDataFrame([], fields) if out is None else out

    # what users call

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last if none is named."""
        return self._newest(self.manifest(version)).drop(GONE)

    def _put(self, rows: DataFrame, manifest: dict) -> int:
        name = self._write(rows, manifest, False)
        self._publish(manifest["version"] + 1, manifest | {"parts": [*manifest["parts"], name]})
        return self.compact() if len(manifest["parts"]) >= MOST_PARTS else manifest["version"] + 1

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """K3, K4, K6: the new version's number, in which rows stand for those with their ids."""
        manifest = self.manifest()
        key, fields = manifest["key"], T.StructType.fromJson(manifest["schema"])
        known = F.when(F.col(key).isNull(), F.raise_error(F.lit("a row has no id"))).otherwise(F.col(key)).alias(key)
        best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order) if order else F.lit(0)))
        own = rows.withColumn("__n", best).filter("__n = 1")
        return self._put(own.select(*[known if f.name == key else F.col(f.name).cast(f.dataType) for f in fields], F.lit(False).alias(GONE)), manifest)

    def delete(self, ids: DataFrame) -> int:
        """K7: the new version's number, in which no row has one of the ids."""
        manifest = self.manifest()
        key, fields = manifest["key"], T.StructType.fromJson(manifest["schema"])
        own = ids.select(F.col(key).cast(fields[key].dataType)).filter(F.col(key).isNotNull()).distinct()
        return self._put(own.select(*[F.col(key) if f.name == key else F.lit(None).cast(f.dataType).alias(f.name) for f in fields], F.lit(True).alias(GONE)), manifest)

    def compact(self) -> int:
        """One part in place of all; no rows are shuffled."""
        manifest = self.manifest()
        name = self._write(self._newest(manifest), manifest, True)
        self._publish(manifest["version"] + 1, manifest | {"parts": [name]})
        return manifest["version"] + 1

    def clean(self, kept: int = KEPT) -> None:
        """Delete manifests but the last ``kept``, and parts that none of these names."""
        numbers = self._numbers()
        named = {name for n in numbers[-kept:] for name in self.manifest(n)["parts"]}
        for n in numbers[:-kept]:
            self._fs.delete(self._at("manifests", f"{n:09d}.json"), False)
        folder = self._at("parts")
        for f in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if f.getPath().getName() not in named:
                self._fs.delete(f.getPath(), True)
