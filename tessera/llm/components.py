"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

MOST_ROUNDS, SALTS = 60, 16
#: A hash table of so many rows takes 2 MB; four are made at once in the driver in each round, and stay there until it collects garbage.
BROADCAST_ROWS = 30_000


def components(links: DataFrame, a: str, b: str, scratch: Scratch, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """node, label for every node of a link; the label is the component's least node. Nodes may be of any ordered type.

    In a round all nodes of one label get the least label among theirs and their neighbours', then that label's label, so a chain
    takes about as many rounds as the logarithm of its length. Minima are
    aggregated before they are shuffled. Labels of up to ``broadcast_rows`` nodes are broadcast; more are joined, and then the links of a
    node and the nodes of a label are dealt to ``SALTS`` places, so that neither is a hot group. Each round is written to the
    shared folder, so that a lost executor costs no earlier round.
    """
    own = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    edges = scratch.keep(own.unionByName(own.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = scratch.keep(edges.groupBy(F.col("y").alias("node")).agg(F.least(F.col("y"), F.min("x")).alias("label")))
    few = labels.count() <= broadcast_rows
    ends = None
    if not few:
        plain, edges = edges, scratch.keep(edges.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")))
        scratch.drop(plain)
        ends = scratch.keep(edges.select("y", "salt").distinct())
    for _ in range(MOST_ROUNDS):
        if few:
            told = edges.join(F.broadcast(labels.select("node", "label")), F.col("y") == F.col("node"))
        else:
            told = edges.join(ends.join(labels, F.col("y") == F.col("node")).select("y", "salt", "label"), ["y", "salt"])
        near = told.groupBy("x").agg(F.min("label").alias("low"))
        before = labels.select("node", "label")
        before = F.broadcast(before) if few else before
        better = near.join(before, F.col("node") == F.col("x")).select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        better = better.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        # What any node of a label has found holds for all of them, and so does the label of that label.
        parts = better if few else better.groupBy("old", "salt").agg(F.min("label").alias("label"))
        roots = parts.groupBy("old").agg(F.min("label").alias("best"))
        heads = before.select(F.col("node").alias("best"), F.col("label").alias("top"))
        roots = roots.join(heads, "best").select("old", F.least("best", "top").alias("to"))
        if few:
            jumped = better.join(F.broadcast(roots), "old")
        else:
            jumped = better.join(parts.select("old", "salt").join(roots, "old"), ["old", "salt"])
        jumped = jumped.select("node", "old", F.least("label", "to").alias("label"))
        jumped = scratch.keep(jumped)
        scratch.drop(labels)
        labels = jumped
        if jumped.filter(F.col("old") != F.col("label")).isEmpty():
            scratch.drop(edges, *([ends] if ends is not None else []))
            return jumped.select("node", "label")
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
