"""Listings, rollups, quality figures, usage figures."""

from pyspark.sql import functions as F

from tessera.operators import analytics
from tessera.plans.tables import table
from tessera.registry import query


def paths(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.concat_ws("/", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "n_name", F.concat("c_mktsegment", F.lit("-"), F.col("c_custkey").cast("string"), F.lit(".md"))).alias("path"))


PATHS = "p AS (SELECT 'r' || n_regionkey || '/' || n_name || '/' || c_mktsegment || '-' || c_custkey || '.md' path, 'r' || n_regionkey a, 'r' || n_regionkey || '/' || n_name b FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query("folder_listing", f"WITH {PATHS} SELECT b folder, list_sort(list(path)) paths FROM p GROUP BY 1")
def folder_listing(spark, d):
    return analytics.listing(paths(spark, d))


@query("scope_rollup", f"WITH {PATHS} SELECT scope, count(DISTINCT path) pages FROM (SELECT a scope, path FROM p UNION ALL SELECT b, path FROM p) GROUP BY 1")
def scope_rollup(spark, d):
    return analytics.scopes(paths(spark, d))


@query("latest_update", "SELECT greatest((SELECT max(ts) FROM events), (SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) updated")
def latest_update(spark, d):
    return analytics.latest([(table(spark, d, "events"), "ts"), (table(spark, d, "orders"), "o_orderdate"), (table(spark, d, "lineitem"), "l_shipdate")])


@query("status_rollup", "SELECT source, lang, count(*) files, sum(n_chars)::BIGINT chars FROM documents GROUP BY ROLLUP (source, lang)")
def status_rollup(spark, d):
    return table(spark, d, "documents").rollup("source", "lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@query("chunk_type_counts", "SELECT event_type, count(*) n FROM events GROUP BY 1")
def chunk_type_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("api_index", "SELECT p_type, count(DISTINCT p_name) n, list_sort(list_distinct(list(p_name))) AS names FROM part GROUP BY 1")
def api_index(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.countDistinct("p_name").alias("n"), F.array_sort(F.collect_set("p_name")).alias("names"))


@query("section_topics", f"WITH {PATHS} SELECT a section, count(*) pages, count(DISTINCT b) folders FROM p WHERE a = 'r1' OR starts_with(b, 'r1/') GROUP BY 1")
def section_topics(spark, d):
    rows = paths(spark, d).select("path", F.split_part("path", F.lit("/"), F.lit(1)).alias("section"), analytics.folder_of(F.col("path")).alias("folder"))
    return rows.filter((F.col("folder") == "r1") | F.col("folder").startswith("r1/")).groupBy("section").agg(F.count("*").alias("pages"), F.countDistinct("folder").alias("folders"))


MARKS = "m AS (SELECT l_orderkey, l_returnflag, l_linestatus, (l_quantity % 6)::INT relevance, (l_linenumber % 6)::INT completeness, (l_partkey % 6)::INT correctness, (l_suppkey % 6)::INT api_coverage, (l_orderkey % 6)::INT conciseness FROM lineitem)"


def marks(spark, d):
    columns = dict(relevance="l_quantity", completeness="l_linenumber", correctness="l_partkey", api_coverage="l_suppkey", conciseness="l_orderkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", *[(F.col(c) % 6).cast("int").alias(n) for n, c in columns.items()])


DIMS = analytics.DIMENSIONS
STATS_SQL = ", ".join([f"round(avg(CASE WHEN {d} > 0 THEN {d} END), 6) avg_{d}" for d in DIMS] + [f"median(CASE WHEN {d} > 0 THEN {d} END)::DOUBLE median_{d}" for d in DIMS])


@query(
    "quality_grouping_sets",
    f"WITH {MARKS} SELECT l_returnflag, l_linestatus, count(*) n, round(avg(CASE WHEN {' + '.join(DIMS)} > 0 THEN ({' + '.join(DIMS)}) / 5.0::DOUBLE END), 6) composite, {STATS_SQL} FROM m GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
)
def quality_grouping_sets(spark, d):
    out = analytics.group_stats(marks(spark, d), ["l_returnflag", "l_linestatus"])
    return out.select(*[F.round(c, 6).alias(c) if c == "composite" or c.startswith("avg_") else F.col(c) for c in out.columns])


@query(
    "pass_rates",
    f"WITH {MARKS}, v AS ({' UNION ALL '.join(f'SELECT {x!r} dimension, {y} v FROM m' for x, y in [*((n, n) for n in DIMS), ('all', 'least(' + ', '.join(DIMS) + ')')])}) SELECT dimension, t::INT threshold, round(avg(CASE WHEN v >= t THEN 1.0::DOUBLE ELSE 0 END), 6) rate FROM v, (VALUES (5), (4), (3), (2)) x(t) GROUP BY ALL",
)
def pass_rates(spark, d):
    return analytics.pass_rates(marks(spark, d)).withColumn("rate", F.round("rate", 6))


@query("judge_median", f"WITH {MARKS} SELECT l_orderkey, {', '.join(f'trunc(median(CASE WHEN {n} > 0 THEN {n} END))::INT {n}' for n in DIMS)} FROM m GROUP BY 1")
def judge_median(spark, d):
    return analytics.judge_median(marks(spark, d), ["l_orderkey"])


@query(
    "latency_p95",
    "SELECT event_type, list_sort(list(value) FILTER (value > 0))[(len(list(value) FILTER (value > 0)) * 0.95)::DOUBLE::INT + CASE WHEN (len(list(value) FILTER (value > 0)) * 0.95)::DOUBLE::INT > len(list(value) FILTER (value > 0)) * 0.95 THEN 0 ELSE 1 END] p95 FROM events GROUP BY 1",
)
def latency_p95(spark, d):
    return analytics.p95_by(table(spark, d, "events"), ["event_type"], "value")


@query("session_history", "SELECT user_id, event_id, n::INT n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) n FROM events) WHERE n <= 10")
def session_history(spark, d):
    return analytics.last_of_session(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", "n")


@query("prompt_packing", "SELECT source, doc_id, running::BIGINT running FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY lang, doc_id ROWS UNBOUNDED PRECEDING) running FROM documents) WHERE running <= 20000")
def prompt_packing(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", "lang", "n_chars")
    return analytics.packed(rows, ["lang", "doc_id"], F.col("n_chars"), 20000, ["source"]).select("source", "doc_id", "running")


@query("prompt_packing_whole", "SELECT source, doc_id, running::BIGINT running FROM (SELECT source, doc_id, sum(n_chars) OVER (ORDER BY source, lang, doc_id ROWS UNBOUNDED PRECEDING) running, sum(n_chars) OVER () total FROM documents) WHERE running <= 1000000")
def prompt_packing_whole(spark, d):
    """A17 without groups."""
    rows = table(spark, d, "documents").select("source", "doc_id", "lang", "n_chars")
    return analytics.packed(rows, ["source", "lang", "doc_id"], F.col("n_chars"), 1_000_000).select("source", "doc_id", "running")


EXPECTED = "list_distinct(list_filter(string_split(lower(b.text), ' '), lambda x: len(x) > 4))"


@query(
    "recall_precision",
    """WITH r AS (SELECT p_partkey, string_split(p_name, ' ') want, lower(p_name || ' ' || p_type) AS text, [lower(p_type), split_part(lower(p_name), ' ', 1)] found FROM part),
    s AS (SELECT p_partkey, len(list_filter(want, lambda x: contains(text, lower(x))))::DOUBLE / len(want) recall, len(list_filter(found, lambda f: len(list_filter(want, lambda w: contains(lower(f), lower(w)))) > 0))::DOUBLE / len(found) p, len(list_filter(want, lambda w: len(list_filter(found, lambda f: contains(lower(f), lower(w)))) > 0))::DOUBLE / len(want) rr FROM r)
    SELECT p_partkey, round(recall, 6) recall, round(p, 6) "precision", round(CASE WHEN p + rr > 0 THEN 2 * p * rr / (p + rr) END, 6) f1 FROM s""",
)
def recall_precision(spark, d):
    rows = table(spark, d, "part").select(
        "p_partkey", F.split("p_name", " ").alias("want"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("text"), F.array(F.lower("p_type"), F.split_part(F.lower("p_name"), F.lit(" "), F.lit(1))).alias("found")
    )
    p, f1 = analytics.precision_f1(F.col("want"), F.col("found"))
    return rows.select("p_partkey", F.round(analytics.recall(F.col("want"), F.col("text")), 6).alias("recall"), F.round(p, 6).alias("precision"), F.round(f1, 6).alias("f1"))


@query("provider_pivot", "SELECT l_linestatus, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 2) A, round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 2) N, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 2) R FROM lineitem GROUP BY 1")
def provider_pivot(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.sum("l_quantity"), 2))


@query("label_pass_rates", "SELECT source, count(*) n, round(avg(quality), 6) good, round(avg(toxic), 6) toxic FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def label_pass_rates(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("good"), F.round(F.avg("toxic"), 6).alias("toxic"))


@query("token_cost", "SELECT event_id, round(CASE WHEN user_id % 5 = 0 AND event_type = 'click' THEN NULL ELSE (CASE WHEN user_id % 5 = 0 THEN 0 ELSE event_id END + CASE WHEN event_type = 'click' THEN 0 ELSE user_id END) * 0.02::DOUBLE / 1e6 END, 12) AS cost FROM events")
def token_cost(spark, d):
    from tessera.functions.text import cost

    rows = table(spark, d, "events")
    embed, rank = F.when(F.col("user_id") % 5 != 0, F.col("event_id")), F.when(F.col("event_type") != "click", F.col("user_id"))
    return rows.select("event_id", F.round(cost(embed, rank), 12).alias("cost"))
