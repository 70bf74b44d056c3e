"""Benchmark decontamination: Wu-Manber search for every benchmark window in every document.

Symbols are words, blocks are pairs of words. A shift table over blocks tells how far the search may jump
without missing a window; where it tells 0, the suffix bucket of the block lists the windows that end so,
and those are compared word by word. Windows of one length share a table; items shorter than a window form
one window of their own length, with their own table.

Rows in, rows out: nothing is shuffled. The windows are broadcast in shards of at most ``shard_bytes`` of
item text, one pass of the documents for each shard, so that what is broadcast is bounded.

Null and empty texts have no words. Items without words match nothing; items with null id mark words as hit
but can't be named. Equal items under several ids are all named. Repeated rows are each judged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import numbered, pick, session_of, ship, words_of

WINDOW = 13
SHARD_BYTES = 16 << 20
RESULT = "n_words bigint, spans array<struct<start:bigint,len:bigint>>, items array<string>"


class Table:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], set]):
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list] = defaultdict(list)
        for words, items in windows.items():
            for end in range(self.block, length + 1):
                key = b" ".join(words[end - self.block : end])
                self.shift[key] = min(self.shift.get(key, self.most), length - end)
            self.bucket[key].append((b" ".join(words), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """Start of each occurrence, with what occurs there."""
        n, m, most, shift = len(words), self.length, self.most, self.shift.get
        i = m - 1
        if self.block == 1:
            while i < n:
                step = shift(words[i], most)
                if step:
                    i += step
                    continue
                for text, items in self.bucket[words[i]]:
                    yield i, items
                i += 1
            return
        while i < n:
            key = words[i - 1] + b" " + words[i]
            step = shift(key, most)
            if step:
                i += step
                continue
            here = b" ".join(words[i - m + 1 : i + 1])
            for text, items in self.bucket[key]:
                if text == here:
                    yield i - m + 1, items
            i += 1


def tables(rows: list[tuple[object, str | None]], window: int) -> list[Table]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item, text in rows:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            by_length[size][tuple(words[i : i + size])].add(None if item is None else str(item))
    return [Table(n, w) for n, w in sorted(by_length.items())]


def scan_text(words: list[bytes], found: list[Table]) -> tuple[list[tuple[int, int]], set]:
    """Maximal hit runs (start, length) and the items that occur."""
    runs, items = [], set()
    for table in found:
        for start, who in table.search(words):
            items |= who
            runs.append((start, start + table.length))
    items.discard(None)
    if len(found) > 1:
        runs.sort()
    merged: list[list[int]] = []
    for a, b in runs:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return [(a, b - a) for a, b in merged], items


def _merge(spans: list[dict], more: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, n in sorted([(s["start"], s["len"]) for s in spans] + more):
        if out and a <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n - out[-1][0])
        else:
            out.append([a, n])
    return [tuple(x) for x in out]


def _struct(n, spans, items) -> pa.Array:
    span = pa.struct([("start", pa.int64()), ("len", pa.int64())])
    return pa.StructArray.from_arrays(
        [
            pa.array(n, pa.int64()),
            pa.array([[{"start": a, "len": b} for a, b in s] for s in spans], pa.list_(span)),
            pa.array(items, pa.list_(pa.string())),
        ],
        names=["n_words", "spans", "items"],
    )


def _pass(broadcast, window: int, first: bool):
    def run(batches):
        built = tables(broadcast.value, window)
        for columns in batches:
            texts = columns[0] if isinstance(columns, tuple) else columns
            before = None if first else columns[1]
            n, spans, items = [], [], []
            for k in range(len(texts)):
                words = words_of(texts[k].as_py())
                own, who = scan_text(words, built)
                if before is not None:
                    old = before[k].as_py()
                    own, who = _merge(old["spans"], own), who | set(old["items"])
                n.append(len(words))
                spans.append(own)
                items.append(sorted(who))
            yield _struct(n, spans, items)

    if first:

        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return run(batches)

        return F.arrow_udf(one, RESULT)

    def two(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return run(batches)

    return F.arrow_udf(two, RESULT)


def shards(benchmark: DataFrame, item: str, text: str, shard_bytes: int) -> Iterator[list[tuple]]:
    """Items in parts of bounded size; one part at a time is held on the driver. An empty table gives one empty part."""
    part, size, given = [], 0, False
    for row in pick(benchmark, item, text).toLocalIterator():
        if part and size + len(row[1] or "") > shard_bytes:
            yield part
            part, size, given = [], 0, True
        size += len(row[1] or "")
        part.append((row[0], row[1]))
    if part or not given:
        yield part


def search(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shard_bytes: int = SHARD_BYTES, into: str = "found",
) -> DataFrame:
    """Documents with a struct column ``into``: n_words, spans (hit word runs) and items (ids that occur, as strings)."""
    spark = session_of(documents)
    ship(spark)
    out, (at,) = numbered(documents, text)
    first = True
    for part in shards(benchmark, item, item_text, shard_bytes):
        shared = spark.sparkContext.broadcast(part)
        f = _pass(shared, window, first)
        out = out.withColumn("__found", f(F.col(at)) if first else f(F.col(at), F.col("__found")))
        first = False
    return out.toDF(*documents.columns, into)


def n_hit(found: str = "found"):
    return F.aggregate(F.col(f"{found}.spans"), F.lit(0).cast("long"), lambda n, s: n + s["len"])


def contaminated(found: str = "found", share: int = 20):
    """At least one hit word, and at least one word in ``share``."""
    return (n_hit(found) > 0) & (n_hit(found) * share >= F.col(f"{found}.n_words"))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    documents = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    out = search(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("found.items")), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
