"""Usage events as a stream, run to its end."""

import uuid

from pyspark.sql import functions as F

from tessera.plans.tables import table
from tessera.registry import query


@query(
    "usage_stream",
    "SELECT date_trunc('day', ts) AS start, event_type, count(*) n, round(sum(value), 2) total FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events)",
)
def usage_stream(spark, d):
    """Daily windows that the watermark has closed, from the stream's own result table."""
    from tessera.streaming.usage import append, read_events, shared_folder, windowed

    folder = f"{shared_folder(spark)}/usage-{uuid.uuid4().hex}"
    events = read_events(spark, f"{d}/events.parquet*", table(spark, d, "events").schema)
    run = append(windowed(events), f"{folder}/out", f"{folder}/checkpoint")
    run.awaitTermination()
    out = spark.read.schema("start timestamp, event_type string, n bigint, total double").parquet(f"{folder}/out")
    return out.select("start", "event_type", "n", F.round("total", 2).alias("total"))


@query("session_stream", "SELECT user_id, event_id, n::INT n, kind FROM (SELECT user_id, event_id, event_type kind, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) n FROM events) WHERE n <= 10")
def session_stream(spark, d):
    """V8: histories as they stand after all events came in five batches, out of order and a fifth of them twice."""
    from tessera.operators.collection import Collection
    from tessera.streaming import sessions
    from tessera.streaming.usage import shared_folder

    folder = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    part = F.pmod(F.xxhash64("event_id"), F.lit(5))
    sent = events.withColumn("part", part).unionByName(events.withColumn("part", F.pmod(part + 1, F.lit(5))).filter(F.pmod(F.xxhash64("ts"), F.lit(5)) == 0))
    sent.repartition(5, "part").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    told = sessions.histories(stream, "user_id", "ts", "event_id", ["event_type"], late="3650 days")
    kept = Collection.create(spark, f"{folder}/histories", told.schema, "session", int(spark.conf.get("spark.sql.shuffle.partitions")))
    sessions.kept(told, kept, f"{folder}/checkpoint").awaitTermination()
    rows = sessions.listed(kept.read())
    return rows.select(F.col("session").alias("user_id"), F.col("id").alias("event_id"), "n", F.get_json_object("item", "$.event_type").alias("kind"))
