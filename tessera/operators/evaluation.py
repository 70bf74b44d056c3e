"""Evaluation of search providers in sets: one row for each provider and question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.cluster import Workspace
from tessera.functions import text as T
from tessera.operators import analytics, order

#: Figures of a group, with how they are rounded.
FIGURES = {
    "avg_composite": 2, "avg_path_recall": 3, "avg_api_recall": 3, "avg_f1": 3, "avg_latency": 3, "p95_latency": 3, "max_latency": 3, "avg_context_tokens": 0,
    "max_context_tokens": 0, "avg_internal_cost": 6, "total_internal_cost": 4, "avg_external_cost": 6, "total_external_cost": 4,
}


def results(questions: DataFrame, answers: DataFrame, external: dict[str, float] | None = None) -> DataFrame:
    """Answers of providers with their recall, precision, tokens and costs.

    questions: question, framework, intent, difficulty, relevant_paths, relevant_apis; answers: provider, question, text, latency_s,
    embed_tokens, rerank_tokens and the judge's marks. external: the price of a query by provider. A text's paths and their hits are columns before
    they are used, as an expression inside another's lambda is made anew for each element.
    """
    rows = answers.join(questions, "question")
    own = rows.withColumn("__low", F.lower("text")).withColumn("__found", T.paths_in(F.col("text"), r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*"))
    counted = own.withColumns(dict(zip(("__hits", "__covered"), analytics.path_hits(F.col("relevant_paths"), F.col("__found")))))
    precision, f1 = analytics.rates(F.col("relevant_paths"), F.col("__found"), F.col("__hits"), F.col("__covered"))
    price = F.lit(0.0)
    for provider, cost in (external or {}).items():
        price = F.when(F.col("provider") == provider, F.lit(cost)).otherwise(price)
    return counted.select(
        *map(F.col, rows.columns), analytics.recall(F.col("relevant_paths"), F.col("__low")).alias("path_recall"), analytics.recall(F.col("relevant_apis"), F.col("__low")).alias("api_recall"),
        precision.alias("path_precision"), f1.alias("f1"), T.token_count(F.col("text")).alias("context_tokens"), T.cost(F.col("embed_tokens"), F.col("rerank_tokens")).alias("internal_cost"), price.alias("external_cost"),
    )


def above_zero(name: str) -> Column:
    return F.when(F.col(name) > 0, F.col(name))


def selected(rows: DataFrame, by: list[str], dims: tuple[str, ...], keep) -> DataFrame:
    """by, median_* of the marks above 0, p95_latency: order statistics of all columns in the same two passes."""
    columns = [*dims, "latency_s"]
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), above_zero(c).cast("double").alias("value")) for c in columns])).alias("__x")).select(*by, "__x.*")
    found = order.at_ranks(long, [*by, "column"], "value", order.middle() | {"p95": (0.95, F.floor(F.col("n") * F.lit(0.95)))}, keep)
    of = lambda c, value: F.max(F.when(F.col("column") == c, value))
    medians = [F.round(of(d, (F.col("lower") + F.col("upper")) / 2), 2).alias(f"median_{d}") for d in dims]
    return found.groupBy(*by).agg(*medians, of("latency_s", F.col("p95")).alias("p95_latency"))


def group_figures(rows: DataFrame, by: list[str], dims: tuple[str, ...] = analytics.DIMENSIONS) -> DataFrame:
    """All figures of each group. Rows are kept as a table, as three passes read them; groups may be of any size."""
    keep = Workspace(rows.sparkSession).keep
    rows = keep(rows)
    composite = F.when(F.greatest(*map(F.col, dims)) > 0, sum((F.col(d) for d in dims), F.lit(0)) / len(dims))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("count"), *[F.round(F.avg(above_zero(d)), 2).alias(f"avg_{d}") for d in dims],
        F.avg(composite).alias("avg_composite"), F.avg("path_recall").alias("avg_path_recall"), F.avg("api_recall").alias("avg_api_recall"), F.avg("f1").alias("avg_f1"),
        F.avg(above_zero("latency_s")).alias("avg_latency"), F.max(above_zero("latency_s")).alias("max_latency"),
        F.avg(above_zero("context_tokens")).alias("avg_context_tokens"), F.max(above_zero("context_tokens")).cast("double").alias("max_context_tokens"),
        F.avg("internal_cost").alias("avg_internal_cost"), F.sum("internal_cost").alias("total_internal_cost"),
        F.avg("external_cost").alias("avg_external_cost"), F.sum("external_cost").alias("total_external_cost"),
    ).join(selected(rows, by, dims, keep), by, "left")
    others = [c for c in out.columns if c not in FIGURES]
    return out.select(*others, *[F.round(F.col(n), d).alias(n) for n, d in FIGURES.items()])


def comparison(figures: DataFrame, providers: list[str], names: list[str], by: str = "provider") -> DataFrame:
    """A row for each figure, a column for each provider."""
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("figure"), F.col(name).cast("double").alias("value")) for i, name in enumerate(names)])
    rows = figures.select(by, F.explode(pairs).alias("f")).select(by, "f.place", "f.figure", "f.value")
    return rows.groupBy("place", "figure").pivot(by, providers).agg(F.first("value")).drop("place")


def report_lines(figures: DataFrame, names: list[str], by: str = "provider") -> DataFrame:
    """For each provider a report of one line for each figure that it has; N/A for others."""
    lines = [F.concat(F.rpad(F.lit(name + ":"), 24, " "), F.coalesce(F.format_number(F.col(name).cast("double"), 3), F.lit("N/A"))) for name in names]
    return figures.select(by, F.concat_ws("\n", F.concat(F.lit("EVALUATION REPORT: "), F.upper(by)), *lines).alias("report"))


def save_report(figures: DataFrame, names: list[str], path: str) -> None:
    """The figures as JSON, the reports as text."""
    figures.write.mode("overwrite").json(f"{path}/json")
    report_lines(figures, names).select("report").write.mode("overwrite").text(f"{path}/txt")
