"""Change detection, merges and index state."""

from pyspark.sql import functions as F

from tessera.functions.text import content_hash, point_id
from tessera.operators import incremental
from tessera.plans.tables import table
from tessera.registry import query


def current(spark, d):
    rows = table(spark, d, "documents").filter("doc_id % 13 <> 0")
    return rows.select("doc_id", content_hash(F.col("text")).alias("content_hash"), F.lit("v2").alias("version"))


def state(spark, d):
    rows = table(spark, d, "documents").filter("doc_id % 10 <> 0")
    altered = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return rows.select("doc_id", content_hash(altered).alias("content_hash"), F.when(F.col("doc_id") % 11 == 0, "v1").otherwise("v2").alias("version"))


@query(
    "change_detection",
    """SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'deleted' WHEN doc_id % 10 = 0 THEN 'new' WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'changed' ELSE 'unchanged' END change
    FROM documents WHERE NOT (doc_id % 13 = 0 AND doc_id % 10 = 0)""",
)
def change_detection(spark, d):
    return incremental.changes(state(spark, d), current(spark, d), ["doc_id"])


@query("upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END o_totalprice FROM orders")
def upsert(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", "o_totalprice").filter("o_orderkey % 5 <> 0 OR o_orderkey % 3 <> 0")
    new = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return incremental.upsert(old, new, ["o_orderkey"])


@query("delete_by_key", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4)")
def delete_by_key(spark, d):
    gone = table(spark, d, "customer").filter("c_nationkey = 4").select(F.col("c_custkey").alias("o_custkey"))
    return incremental.delete(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query("file_state", "SELECT source, lang, list_sort(list(doc_id)) chunk_ids FROM documents GROUP BY ALL")
def file_state(spark, d):
    rows = table(spark, d, "documents").select("source", "lang", F.col("doc_id").alias("chunk_id"))
    return incremental.file_state(rows, ["source", "lang"])


@query("last_wins", "SELECT p_name, arg_max(p_retailprice, p_partkey) p_retailprice, max(p_partkey) p_partkey FROM part GROUP BY 1")
def last_wins(spark, d):
    return incremental.last_wins(table(spark, d, "part").select("p_name", "p_partkey", "p_retailprice"), "p_name", "p_partkey")


@query("content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) content_hash FROM documents")
def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))


@query("point_id", "SELECT doc_id, ('0x' || substr(sha256('c' || doc_id), 1, 15))::BIGINT point_id FROM documents")
def point_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", point_id(F.concat(F.lit("c"), F.col("doc_id").cast("string"))).alias("point_id"))


@query(
    "collection_versions",
    """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 1 THEN o_totalprice + 1 ELSE o_totalprice END o_totalprice FROM orders WHERE o_orderkey % 7 <> 2
    UNION ALL SELECT -o_orderkey, 'N', o_totalprice FROM orders WHERE o_orderkey % 5 = 2""",
)
def collection_versions(spark, d):
    """K6-K8: a collection after a first load, an upsert of changed and new rows, and a deletion."""
    import uuid

    from tessera.cluster import shared_folder
    from tessera.operators.collection import Collection

    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    stored = Collection.create(spark, f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}", orders.schema, "o_orderkey", int(spark.conf.get("spark.sql.shuffle.partitions")))
    stored.upsert(orders)
    changed = orders.filter("o_orderkey % 5 = 1").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    new = orders.filter("o_orderkey % 5 = 2").withColumns({"o_orderkey": -F.col("o_orderkey"), "o_orderstatus": F.lit("N")})
    stored.upsert(changed.unionByName(new))
    stored.delete(orders.filter("o_orderkey % 7 = 2").select("o_orderkey"))
    return stored.read()
