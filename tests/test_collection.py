"""Stored collections: versions, failed writes, plans without a shuffle."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import collection as C


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id string, v int")


def stored(c, version=None):
    return sorted(map(tuple, c.read(version).collect()))


def test_versions(spark, tmp_path):
    c = C.Collection.create(spark, f"file://{tmp_path}/c", "id string, v int", "id", 4)
    assert stored(c) == []
    c.upsert(rows(spark, ("a", 1), ("b", 2), ("c", 3)))
    two = c.upsert(rows(spark, ("b", 5), ("b", 4), ("d", 6)), order="v")
    c.delete(rows(spark, ("a", 0), ("x", 0)).select("id"))
    c.upsert(rows(spark, ("a", 9)))
    assert stored(c) == [("a", 9), ("b", 5), ("c", 3), ("d", 6)]
    assert stored(c, two) == [("a", 1), ("b", 5), ("c", 3), ("d", 6)]
    again = C.Collection(spark, f"file://{tmp_path}/c")
    assert stored(again) == stored(c)
    assert stored(C.Collection.create(spark, f"file://{tmp_path}/c", "id string, v int", "id", 4)) == stored(c)
    c.compact()
    assert stored(c) == stored(again) and len(c.manifest()["parts"]) == 1
    c.clean(1)
    assert stored(c) == [("a", 9), ("b", 5), ("c", 3), ("d", 6)]
    with pytest.raises(Exception, match="000000002"):
        again.manifest(two)


def test_many_writes_are_compacted(spark, tmp_path):
    c = C.Collection.create(spark, f"file://{tmp_path}/c", "id string, v int", "id", 2)
    for i in range(C.MOST_PARTS + 2):
        c.upsert(rows(spark, ("a", i), (f"k{i}", i)))
    assert len(c.manifest()["parts"]) <= C.MOST_PARTS
    assert stored(c) == [("a", C.MOST_PARTS + 1)] + [(f"k{i}", i) for i in range(C.MOST_PARTS + 2)]


def test_a_failed_write_leaves_the_version(spark, tmp_path):
    c = C.Collection.create(spark, f"file://{tmp_path}/c", "id string, v int", "id", 4)
    c.upsert(rows(spark, ("a", 1)))
    with pytest.raises(Exception, match="broken"):
        c.upsert(rows(spark, ("a", 2), ("b", 3)).withColumn("v", F.when(F.col("id") == "b", F.raise_error(F.lit("broken"))).otherwise(F.col("v")).cast("int")))
    with pytest.raises(Exception, match="no id"):
        c.upsert(rows(spark, (None, 2)))
    assert c.version() == 1 and stored(c) == [("a", 1)]


def test_one_of_two_writers_is_told(spark, tmp_path):
    c = C.Collection.create(spark, f"file://{tmp_path}/c", "id string, v int", "id", 4)
    before = c.manifest()
    c.upsert(rows(spark, ("a", 1)))
    with pytest.raises(C.Conflict):
        c._put(rows(spark, ("a", 2)).withColumn(C.GONE, F.lit(False)), before)
    assert stored(c) == [("a", 1)]


def test_reading_and_compacting_shuffle_nothing(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c = C.Collection.create(spark, f"file://{tmp_path}/c", "id string, v int", "id", 4)
        c.upsert(rows(spark, ("a", 1), ("b", 2)))
        c.upsert(rows(spark, ("b", 3)))
        c.delete(rows(spark, ("a", 3)).select("id"))
        plan = c.read()._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
