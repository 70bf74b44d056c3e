"""Evaluation of providers: results, figures of groups, comparison, reports."""

from pyspark.sql import functions as F

from tessera.operators import analytics, evaluation
from tessera.plans.tables import table
from tessera.registry import query

RESULTS = """r AS (SELECT 'q' || l_orderkey || '-' || l_linenumber question, l_returnflag provider, 'https://docs.example.org/guide/a' || (l_orderkey % 3) || ' about Api' || (l_partkey % 4) || CASE WHEN l_suppkey % 2 = 0 THEN ' https://docs.example.org/guide/b' ELSE '' END AS text,
    ['guide/a' || (l_orderkey % 2), 'guide/b'] paths, ['api1'] apis, (l_quantity % 9) / 4.0::DOUBLE latency, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_partkey END tokens, (l_quantity % 6)::INT relevance, (l_linenumber % 6)::INT completeness, (l_partkey % 6)::INT correctness, (l_suppkey % 6)::INT api_coverage, (l_orderkey % 6)::INT conciseness FROM lineitem),
u AS (SELECT *, list_distinct(list_transform(regexp_extract_all(text, 'org/([a-z0-9/]+)', 1), lambda x: x)) found FROM r),
v AS (SELECT *, len(list_filter(paths, lambda x: contains(lower(text), x)))::DOUBLE / 2 path_recall, CASE WHEN contains(lower(text), 'api1') THEN 1.0::DOUBLE ELSE 0 END api_recall, len(list_filter(found, lambda f: len(list_filter(paths, lambda p: contains(f, p))) > 0))::DOUBLE / len(found) p, len(list_filter(paths, lambda p: len(list_filter(found, lambda f: contains(f, p))) > 0))::DOUBLE / 2 rr,
    len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]')) context_tokens, CASE WHEN tokens IS NOT NULL THEN tokens * 0.02::DOUBLE / 1e6 END internal_cost, CASE WHEN provider = 'N' THEN 0.01::DOUBLE ELSE 0 END external_cost FROM u),
res AS (SELECT *, CASE WHEN p + rr > 0 THEN 2 * p * rr / (p + rr) END f1 FROM v)"""


def results(spark, d):
    rows = table(spark, d, "lineitem")
    question = F.concat(F.lit("q"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    number = lambda c, n: (F.col(c) % n).cast("int").cast("string")
    text = F.concat(F.lit("https://docs.example.org/guide/a"), number("l_orderkey", 3), F.lit(" about Api"), number("l_partkey", 4), F.when(F.col("l_suppkey") % 2 == 0, " https://docs.example.org/guide/b").otherwise(""))
    marks = dict(relevance="l_quantity", completeness="l_linenumber", correctness="l_partkey", api_coverage="l_suppkey", conciseness="l_orderkey")
    answers = rows.select(
        question.alias("question"), F.col("l_returnflag").alias("provider"), text.alias("text"), ((F.col("l_quantity") % 9) / 4.0).cast("double").alias("latency_s"),
        F.when(F.col("l_returnflag") != "A", F.col("l_partkey")).alias("embed_tokens"), F.lit(None).cast("long").alias("rerank_tokens"), *[(F.col(c) % 6).cast("int").alias(n) for n, c in marks.items()],
    )
    questions = rows.select(question.alias("question"), F.array(F.concat(F.lit("guide/a"), number("l_orderkey", 2)), F.lit("guide/b")).alias("relevant_paths"), F.array(F.lit("api1")).alias("relevant_apis")).distinct()
    return evaluation.results(questions, answers, {"N": 0.01})


@query("evaluation_results", f"WITH {RESULTS} SELECT question, provider, path_recall, api_recall, round(p, 6) path_precision, round(f1, 6) f1, context_tokens::INT context_tokens, round(internal_cost, 12) internal_cost, external_cost FROM res")
def evaluation_results(spark, d):
    """V14, A10."""
    rounded = [F.round("path_precision", 6).alias("path_precision"), F.round("f1", 6).alias("f1"), "context_tokens", F.round("internal_cost", 12).alias("internal_cost")]
    return results(spark, d).select("question", "provider", "path_recall", "api_recall", *rounded, "external_cost")


DIMS = analytics.DIMENSIONS
FIGURES_SQL = f"""fig AS (SELECT provider, count(*) "count", {', '.join(f'round(avg(CASE WHEN {d} > 0 THEN {d} END), 2) avg_{d}, median(CASE WHEN {d} > 0 THEN {d} END)::DOUBLE median_{d}' for d in DIMS)},
    round(avg(CASE WHEN greatest({', '.join(DIMS)}) > 0 THEN ({' + '.join(DIMS)}) / 5.0::DOUBLE END), 2) avg_composite, round(avg(path_recall), 3) avg_path_recall, round(avg(api_recall), 3) avg_api_recall, round(avg(f1), 3) avg_f1, round(avg(CASE WHEN latency > 0 THEN latency END), 3) avg_latency,
    round(list_sort(list(latency) FILTER (latency > 0))[floor(count(*) FILTER (latency > 0) * 0.95)::INT + 1], 3) p95_latency, round(max(latency), 3) max_latency, round(avg(context_tokens), 0) avg_context_tokens, max(context_tokens)::DOUBLE max_context_tokens,
    round(avg(internal_cost), 6) avg_internal_cost, round(sum(internal_cost), 4) total_internal_cost, round(avg(external_cost), 6) avg_external_cost, round(sum(external_cost), 4) total_external_cost FROM res GROUP BY 1)"""


@query("provider_figures", f"WITH {RESULTS}, {FIGURES_SQL} SELECT * FROM fig")
def provider_figures(spark, d):
    """A11, A12."""
    return evaluation.group_figures(results(spark, d), ["provider"])


NAMES = ["avg_path_recall", "avg_f1", "max_latency", "avg_internal_cost"]


@query("provider_comparison", f"WITH {RESULTS}, {FIGURES_SQL} " + " UNION ALL ".join(f"SELECT '{n}' figure, " + ", ".join(f"max({n}) FILTER (provider = '{p}')::DOUBLE {p}" for p in "ANR") + " FROM fig" for n in NAMES))
def provider_comparison(spark, d):
    """A18."""
    return evaluation.comparison(evaluation.group_figures(results(spark, d), ["provider"]), ["A", "N", "R"], NAMES)


@query(
    "provider_reports",
    f"WITH {RESULTS}, {FIGURES_SQL} SELECT provider, 'EVALUATION REPORT: ' || provider || " + " || ".join(f"chr(10) || rpad('{n}:', 24, ' ') || coalesce(printf('%.3f', {n}), 'N/A')" for n in NAMES) + " report FROM fig",
)
def provider_reports(spark, d):
    """A18, K13."""
    return evaluation.report_lines(evaluation.group_figures(results(spark, d), ["provider"]), NAMES).select("provider", "report")
