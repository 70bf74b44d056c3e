"""Classes of verified links between the members of hash buckets, by rounds of leaders instead of all pairs.

In the first round the members of a bucket meet its leader, the node of most weight. What matched is one component from then
on, and only members outside a bucket's largest component go on, and never meet one of their own component. In the second round
they meet 32 leaders, each in its largest bucket only, for most find their component there. Then all left meet 1024 leaders of each
bucket they are in, then 32 times as many, and so forth. A bucket is closed when all its members are of one component, or when all of
them have led. So the components are those of all pairs of a bucket, though few pairs are made: a pair is left out only if
its nodes are of one component already, or if an exact bound tells that their texts can't match.

The bound is the parity of hashed parts: texts whose parts differ in d places differ in d bits at most. A similarity of
m / (p + q - m) >= s needs d = p + q - 2 m <= (p + q) (1 - s) / (1 + s).

Members, pairs, links and labels are tables throughout. Joins by bucket and by leader are salted by the size of the bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch
from tessera.llm.components import components

GROWTH, SALTED = 32, 256  # rows of one key that stay together in a join


def parity(parts: np.ndarray, unit: np.ndarray | int, units: int, lanes: int) -> np.ndarray:
    """units x lanes words of 64 bits; each part of a unit flips the bit that its hash names."""
    bits = 64 * lanes
    at = (parts * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40)).astype(np.int64) % bits + unit * bits
    odd = (np.bincount(at, minlength=units * bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(units, lanes)


def lanes_of(lanes: int) -> list[str]:
    return [f"s{i}" for i in range(lanes)]


def gathered(nodes: DataFrame, lanes: int, scratch: Scratch) -> DataFrame:
    """Members (bucket, node, n, weight, size, s0, ...) of the buckets that hold n >= 2 nodes.

    nodes: (node, buckets, size, bits), one row for each node. The weight is how many nodes its buckets hold, so the middle of a group has most.
    """
    rows = nodes.select("node", F.explode("buckets").alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = scratch.keep(rows.join(counts, "bucket"))
    scratch.release()
    own = shared.groupBy("node").agg(F.sum("n").alias("weight"), F.collect_list(F.struct("bucket", "n")).alias("in"))
    flat = nodes.select("node", "size", *[F.col("bits")[i].alias(s) for i, s in enumerate(lanes_of(lanes))])
    out = own.join(flat, "node").withColumn("at", F.explode("in")).select("at.bucket", "node", "at.n", "weight", "size", *lanes_of(lanes))
    out = scratch.keep(out)
    scratch.drop(shared)
    scratch.release()
    return out


def _salts(n: str = "n") -> Column:
    return F.ceil(F.col(n) / SALTED).cast("int")


def candidates(members: DataFrame, leaders: int, similarity: float, lanes: int, narrow: bool = False) -> DataFrame:
    """Distinct pairs (member, leader, a, b, n) of nodes of one bucket and of different labels a, b that may match by the bound.

    narrow: a member meets leaders in its largest bucket only.
    """
    bits = lanes_of(lanes)
    carried = ["weight", "node", "label", "size", *bits]
    slot = F.when(F.col("n") <= leaders, F.col("node")).otherwise(F.pmod(F.xxhash64("node"), F.lit(leaders)))
    heads = members.groupBy("bucket", slot.alias("slot"), "n").agg(F.max(F.struct(*carried)).alias("h"))
    heads = heads.select("bucket", F.explode(F.sequence(F.lit(0), _salts() - 1)).alias("salt"), *[F.col(f"h.{c}").alias(f"h_{c}") for c in carried])
    if leaders > 1:
        parts = members.groupBy("bucket", "label").agg(F.count("*").alias("c"))
        major = parts.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("m")).select("bucket", F.col("m.label").alias("major"))
        members = members.join(major, "bucket").filter("label <> major")
    if narrow:
        largest = members.groupBy("node").agg(F.max(F.struct("n", "bucket")).alias("l")).select("node", "l.bucket")
        members = members.join(largest, ["node", "bucket"])
    met = members.withColumn("salt", F.pmod(F.xxhash64("node"), _salts()).cast("int")).join(heads, ["bucket", "salt"])
    apart = reduce(add, [F.bit_count(F.col(s).bitwiseXOR(F.col(f"h_{s}"))) for s in bits])
    both, least = F.col("size") + F.col("h_size"), (1 - similarity) / (1 + similarity)
    met = met.filter((F.col("label") != F.col("h_label")) & (apart <= both * least + 1e-9) & (F.abs(F.col("size") - F.col("h_size")) <= both * least + 1e-9))
    leads = (F.col("h_weight") > F.col("weight")) | (F.col("h_weight") == F.col("weight")) & (F.col("h_node") > F.col("node"))
    named = [F.when(leads, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("node", "h_node", "member"), ("h_node", "node", "leader"), ("label", "h_label", "a"), ("h_label", "label", "b"))]
    return met.select(*named, "n").groupBy("member", "leader", "a", "b").agg(F.max("n").alias("n"))


def _matches(prepare: Callable, accept: Callable, member: Column, leader: Column) -> Column:
    """Do two texts match? The last leader is kept prepared, for its pairs stand together."""

    @F.arrow_udf("boolean")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        text, known = None, None
        for members, leaders in batches:
            out = []
            for a, b in zip(members.to_pylist(), leaders.to_pylist()):
                if b != text:
                    text, known = b, prepare(b)
                out.append(accept(prepare(a), known))
            yield pa.array(out, pa.bool_())

    return run(member, leader)


def verified(pairs: DataFrame, texts: DataFrame, prepare: Callable, accept: Callable) -> DataFrame:
    """Those of the pairs (member, leader, a, b, n) whose texts match; a leader's text goes to as many places as its bucket asks for."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("member"), _salts()).cast("int"))
    heads = salted.select("leader", "salt").distinct().join(texts.select(F.col("node").alias("leader"), F.col("text").alias("y")), "leader")
    rows = salted.join(texts.select(F.col("node").alias("member"), F.col("text").alias("x")), "member").join(heads, ["leader", "salt"])
    return rows.filter(_matches(prepare, accept, F.col("x"), F.col("y"))).select("member", "leader", "a", "b")


def merged(labels: DataFrame | None, fresh: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels (node, label) after links between labels a and b; a node without a row is its own label."""
    moved = components(fresh, "a", "b", scratch)
    if labels is None:
        return moved
    to = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return scratch.keep(old.unionByName(moved.join(labels, "node", "left_anti").select("node", "label")))


def classes_of(members: DataFrame, texts: DataFrame, prepare: Callable, accept: Callable, similarity: float, lanes: int, scratch: Scratch) -> DataFrame:
    """Labels (node, label) of the nodes in classes of several. members: as ``gathered`` gives them, deleted in the
    end; texts: (node, text), one row for each node."""
    left, table, labels, leaders, narrow = members.withColumn("label", F.col("node")), members, None, 1, False
    while True:
        pairs = scratch.keep(candidates(left, leaders, similarity, lanes, narrow))
        fresh = scratch.keep(verified(pairs, texts, prepare, accept))
        if labels is None or not fresh.isEmpty():
            labels = merged(labels, fresh, scratch)
        left = left.filter(F.col("n") > (2 if narrow or leaders == 1 else leaders))
        left = left.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = left.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket")
        left = scratch.keep(left.join(several, "bucket", "left_semi"))
        scratch.drop(pairs, fresh, table)
        scratch.release()
        if left.isEmpty():
            return labels
        table, leaders, narrow = left, leaders * GROWTH, leaders == 1
