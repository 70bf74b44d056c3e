"""Near-duplicate documents by Order MinHash and banded alignment.

Words are runs of letters and digits, lower-cased in ASCII; a k-mer is five words. The n-th occurrence of a k-mer is an
element of its own. Each of ``SKETCHES`` sketches takes the ``SAMPLED`` elements of least hash and keeps them in text
order; texts that share a sketch are candidates. Being order-sensitive, a sketch follows edit similarity, not just
common content. Candidates are verified by aligning their k-mers inside a band (bit-parallel longest common subsequence): with m matched of p and q
k-mers, m / (p + q - m) must reach 0.8. The band holds every alignment that can reach it.

Copies of one text are one node from the start: a 64-bit hash of its words. In each bucket, members meet a few leaders instead of each
other, and by an exact bound only those that they can match (see ``buckets``). Classes are the components of all links between candidates.

Null text has no words and belongs to no class but its own; so does every text without a word. Texts of under five words have one
k-mer, all of their words. Repeated rows and equal texts are of one class; so are texts whose words are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.buckets import classes_of, gathered, parity
from tessera.llm.common import WORD_CHARACTERS, Scratch, numbered, pick, session_of, ship, words_of

WORDS, SIMILARITY = 5, 0.8
SKETCHES, SAMPLED = 20, 6
LANES, SALTS = 32, 16  # words of 64 bits for the bound; places of the rows of one class


def runs_of(own: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k of the hashed words."""
    n = len(own) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + own[i : i + n]
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def kmers(words: list[bytes], k: int = WORDS) -> np.ndarray:
    """Hash of every run of k words; of all words, if they are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    return runs_of(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64), min(k, len(words)))


def occurrences(values: np.ndarray) -> np.ndarray:
    """How many times each value stood before."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    starts = np.maximum.accumulate(np.where(first, np.arange(len(values)), 0))
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - starts
    return out


def sketches(found: np.ndarray, m: int = SKETCHES, sampled: int = SAMPLED) -> np.ndarray:
    """One hash for each sketch: the sampled k-mers in text order, after occurrence-labelled minima."""
    labelled = found + occurrences(found).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    take = min(sampled, len(found))
    salts = (np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))[:, None]
    at = []
    for i in range(0, m, rows := max(1, (1 << 20) // len(found))):  # the sketches of a very long text one after another
        h = (labelled ^ salts[i : i + rows]) * np.uint64(0xE7037ED1A0B428DB)
        at.append(np.sort(np.argpartition(h, take - 1, axis=1)[:, :take], axis=1))
    chosen = found[np.concatenate(at)]
    total = np.arange(1, m + 1, dtype=np.uint64)
    for x in chosen.T:
        total = (total ^ x) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Do the k-mers align to m / (p + q - m) >= least? Bit-parallel, in a band as wide as that allows."""
    p, q = len(a), len(b)
    need = int(np.ceil(least * (p + q) / (1 + least) - 1e-9))
    if min(p, q) < need or need == 0:
        return False
    common_a, common_b = np.isin(a, b), np.isin(b, a)
    if min(common_a.sum(), common_b.sum()) < need:
        return False
    width = p + q - 2 * need
    start, end = 0, 0
    limit = min(p, q)
    same = a[:limit] == b[:limit]
    start = limit if same.all() else int(np.argmin(same))
    same = a[::-1][: limit - start] == b[::-1][: limit - start]
    end = len(same) if same.all() else int(np.argmin(same))
    x, y = a[start : p - end].tolist(), b[start : q - end].tolist()
    if not x or not y:
        return start + end >= need
    masks: dict[int, int] = {}
    for j, value in enumerate(y):
        masks[value] = masks.get(value, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows, band = full, (1 << (2 * width + 1)) - 1
    for i, value in enumerate(x):
        shift = i - width
        match = masks.get(value, 0) & (band << shift if shift >= 0 else band >> -shift)
        if match:
            hit = rows & match
            rows = ((rows + hit) | (rows - hit)) & full
    return start + end + len(y) - rows.bit_count() >= need


def sketch_column(text: Column) -> Column:
    """struct(node, buckets, size, bits): a hash of the words, a bucket for each sketch, how many k-mers, and their parity; null without words."""

    @F.arrow_udf("node bigint, buckets array<bigint>, size int, bits array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            nodes, buckets, sizes, bits = [], [], [], []
            for text in column:
                words = words_of(text.as_py())
                found = kmers(words)
                nodes.append(xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else None)
                buckets.append(sketches(found).view(np.int64) if words else None)
                sizes.append(len(found))
                bits.append(parity(found, 0, 1, LANES)[0] if words else None)
            lists = pa.list_(pa.int64())
            yield pa.StructArray.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(buckets, lists), pa.array(sizes, pa.int32()), pa.array(bits, lists)], names=["node", "buckets", "size", "bits"]
            )

    return run(text)


def prepare(text: str) -> np.ndarray:
    return kmers(words_of(text))


def row_id(key: Column, text: Column) -> Column:
    """What tells rows apart; rows of one key and one text are equal."""
    return F.xxhash64(key.cast("string"), text)


def classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (rid, key, node) of the texts that have words, and labels (node, label) of the nodes in classes of several."""
    spark = session_of(documents)
    ship(spark)
    scratch = Scratch(spark)
    rows = pick(documents, key, text).toDF("key", "text").withColumn("rid", row_id(F.col("key"), F.col("text")))
    own = rows.select("rid", "key", sketch_column(F.col("text")).alias("s")).filter(F.col("s.node").isNotNull())
    placed = scratch.keep(own.select("rid", "key", "s.*"))
    nodes = placed.groupBy("node").agg(*[F.first(c).alias(c) for c in ("buckets", "size", "bits")], F.min("rid").alias("rid"))
    nodes = scratch.keep(nodes)
    scratch.release()
    members = gathered(nodes, LANES, scratch)
    homes = nodes.join(members.select("node").distinct(), "node", "left_semi").select("rid", "node")
    texts = scratch.keep(rows.select("rid", "text").join(homes, "rid").dropDuplicates(["node"]).select("node", "text"))
    scratch.drop(nodes)
    scratch.release()
    labels = classes_of(members, texts, prepare, aligned, SIMILARITY, LANES, scratch)
    scratch.drop(texts)
    return placed.select("rid", "key", "node"), labels


def keep_one(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of least key of each class, in the columns of documents; rows without words all stay."""
    placed, labels = classes(documents, key, text)
    placed = placed.join(labels, "node", "left").select("rid", "key", F.coalesce("label", "node").alias("class"))
    firsts = placed.groupBy("class").agg(F.min(F.struct("key", "rid")).alias("first"), F.min("rid").alias("low"), F.max("rid").alias("high"))
    # The rows that go: found within each class, whose rows are dealt to many places.
    salt = F.pmod("rid", F.lit(SALTS)).alias("salt")
    told = placed.select("class", salt).distinct().join(firsts.filter("low < high").select("class", F.col("first.rid").alias("stays")), "class")
    gone = placed.withColumn("salt", salt).join(told, ["class", "salt"]).filter("rid <> stays").select(F.col("rid").alias("__rid")).distinct()
    own, (at_key, at_text) = numbered(documents, key, text)
    words = F.coalesce(F.col(at_text).rlike(WORD_CHARACTERS), F.lit(False))
    with_words = own.filter(words).withColumn("__rid", row_id(F.col(at_key), F.col(at_text)))
    kept = with_words.dropDuplicates(["__rid"]).join(gone, "__rid", "left_anti").drop("__rid")
    return kept.unionByName(own.filter(~words)).toDF(*documents.columns)


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id (the least key of its class) and class_size, one row for each document; those without words are classes of their own."""
    placed, labels = classes(documents, key, text)
    named = placed.join(labels, "node", "left").select(F.coalesce("label", "node").alias("class"), "key", F.pmod("rid", F.lit(SALTS)).alias("salt"))
    parts = named.groupBy("class", "salt").agg(F.min("key").alias("low"), F.count("*").alias("n"))
    sizes = parts.groupBy("class").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"))
    told = parts.select("class", "salt").join(sizes, "class")
    with_words = named.join(told, ["class", "salt"]).select("key", F.coalesce("class_id", "key").alias("class_id"), "class_size")
    own = pick(documents, key, text).toDF("key", "text")
    without = own.filter(~F.coalesce(F.col("text").rlike(WORD_CHARACTERS), F.lit(False))).select("key", F.col("key").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return with_words.unionByName(without).withColumnRenamed("key", key)


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
