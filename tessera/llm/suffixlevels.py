"""Removal of long repeated byte strings by families of suffix arrays.

A string of ``LENGTH`` bytes counts as repeated if it also starts anywhere else. Every start of such a string has an
anchor: among the positions of its first ``SPREAD`` 16-byte grams the one of least hash, the leftmost if they tie. Equal
strings have their anchors at equal distance, so they can be looked for apart by what stands at the anchor: the key,
a hash of the bytes that all starts of one anchor share. The starts of one anchor lie in a row; the text from the first
start to the end of the last string is their segment.

1. Keys of one anchor only hold nothing repeated. (Sums of two hashes for each key, aggregated before they are shuffled.)
2. A segment that occurs twice is repeated throughout, and no further text of it is needed.
3. The texts come in ``BATCHES`` batches. Under a key of several different segments, the suffixes of a batch are sorted into a suffix
   array, which is merge-scanned against the levels of the key's index for strings of ``LENGTH`` bytes in common, and then becomes a level
   itself; two levels of like size merge into one of twice the size. So n suffixes are merged log n times. The index is dealt by
   key, for equal strings share one.
4. Keys of over ``HOT_SEGMENTS`` segments would be hot groups. Their starts are compared by the hash of their string, in
   counts that are aggregated before they are shuffled. This is exact as well.

Texts that occur in several rows are repeated throughout; only one copy is searched. Null text is empty. Texts under ``LENGTH`` bytes
have no such string. Rows are kept one for one. Equal hashes (64 bits of a string, 128 of a text) are taken as equal texts
in steps 1, 2 and 4; step 3 compares bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, pick, session_of, ship

LENGTH, SPREAD, GRAM, HOT_SEGMENTS, SALTS, BATCHES = 400, 200, 16, 128, 64, 16
RESULT = "n_bytes bigint, spans array<struct<start:bigint,len:bigint>>, kept binary"


def grams(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the 16 bytes at each position, in the upper half of 64 bits."""
    h = (data.astype(np.uint64) + np.uint64(0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    factor = 0x8EBC6AF09C88C6E3
    for size in (1, 2, 4, 8):
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor = factor * factor & 0xFFFFFFFFFFFFFFFF
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h & np.uint64(0xFFFFFFFF00000000)


def anchors(data: np.ndarray, length: int = LENGTH, spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first start and last start of each run of starts that share their anchor."""
    starts = len(data) - length + 1
    if starts <= 0:
        return (np.zeros(0, np.int64),) * 3
    least = grams(data) | np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    size = 1
    while 2 * size <= spread:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < spread:
        least = np.minimum(least[: len(least) - (spread - size)], least[spread - size :])
    at = (least[:starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.append(first[1:], starts) - 1


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def segments_of(raw: bytes, length: int = LENGTH, spread: int = SPREAD):
    """Key, segment hash, anchor, first and last start of each segment."""
    at, first, last = anchors(np.frombuffer(raw, np.uint8), length, spread)
    shared, view, digest = length - spread + 1, memoryview(raw), xxhash.xxh3_64_intdigest
    for a, f, e in zip(at.tolist(), first.tolist(), last.tolist()):
        yield signed(digest(view[a : a + shared])), signed(digest(view[f : e + length], seed=a - f)), a, f, e


class IndexFamily:
    """Suffix arrays in levels of growing size; owner is whatever tells a suffix apart."""

    def __init__(self):
        self.levels: list[list[tuple[bytes, object]]] = []
        self.repeated: set = set()

    def scan(self, ordered: list[tuple[bytes, object]]) -> None:
        """Neighbours with equal strings are repeated."""
        for (a, x), (b, y) in zip(ordered, ordered[1:]):
            if a == b:
                self.repeated.add(x)
                self.repeated.add(y)

    def add(self, suffixes: list[tuple[bytes, object]]) -> None:
        if not suffixes:
            return
        batch = sorted(suffixes)
        self.scan(batch)
        for level in self.levels:
            self.merge_scan(batch, level)
        self.levels.append(batch)
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) > len(self.levels[-2]):
            top = self.levels.pop()
            self.levels[-1] = sorted(self.levels[-1] + top)  # two runs in order: a merge in linear time

    def merge_scan(self, batch: list, level: list) -> None:
        i = j = 0
        while i < len(batch) and j < len(level):
            a, b = batch[i][0], level[j][0]
            if a == b:
                self.repeated.add(batch[i][1])
                k = j
                while k < len(level) and level[k][0] == a:
                    self.repeated.add(level[k][1])
                    k += 1
                i += 1
            elif a < b:
                i += 1
            else:
                j += 1


def ranges(starts: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for s in sorted(starts):
        if out and s == out[-1][1] + 1:
            out[-1][1] = s
        else:
            out.append([s, s])
    return out


def _key_rows(length: int, spread: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                keys, codes = [], []
                for text, t in zip(batch.column(0)[i : i + 500].to_pylist(), batch.column(1)[i : i + 500].to_pylist()):
                    for key, _, a, _, _ in segments_of(text.encode("utf-8", "surrogatepass"), length, spread):
                        keys.append(key)
                        codes.append(signed((t + a * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(codes, pa.int64())], names=["key", "code"])

    return run


def _segment_rows(length: int, spread: int):
    names = ["t1", "t2", "key", "seg", "anchor", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = [batch.column(c)[i : i + 500].to_pylist() for c in range(3)]
                rows = [(x, y, *found) for text, x, y in zip(*part) for found in segments_of(text.encode("utf-8", "surrogatepass"), length, spread)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return run


def _cut(length: int):
    """Bytes of the wanted segments of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                rows = []
                for text, wanted in zip(batch.column(0)[i : i + 200].to_pylist(), batch.column(1)[i : i + 200].to_pylist()):
                    raw = text.encode("utf-8", "surrogatepass")
                    rows += [(w["key"], w["seg"], w["hot"], w["batch"], raw[w["first"] : w["last"] + length]) for w in wanted]
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.bool_()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.binary())],
                        names=["key", "seg", "hot", "batch", "data"],
                    )

    return run


MARKS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _index(length: int):
    """Rows of a key stand together, batch by batch; gives the repeated starts of each segment, counted from its first byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, family, suffixes = None, IndexFamily(), []

        def marks():
            found: dict[int, list[int]] = {}
            for seg, start in family.repeated:
                found.setdefault(seg, []).append(start)
            return [(seg, [{"lo": a, "hi": b} for a, b in ranges(starts)]) for seg, starts in found.items()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], MARKS)], names=["seg", "marks"])

        for batch in batches:
            out = []
            for key, part, seg, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if now != (key, part):
                    family.add(suffixes)
                    suffixes = []
                    if now is None or key != now[0]:
                        out += marks()
                        family = IndexFamily()
                    now = key, part
                suffixes += [(data[s : s + length], (seg, s)) for s in range(len(data) - length + 1)]
            yield batch_of(out)
        family.add(suffixes)
        yield batch_of(marks())

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                rows = []
                for seg, data in zip(batch.column(0)[i : i + 200].to_pylist(), batch.column(1)[i : i + 200].to_pylist()):
                    view = memoryview(data)
                    rows += [(signed(xxhash.xxh3_64_intdigest(view[s : s + length])), seg, s) for s in range(len(data) - length + 1)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["window", "seg", "start"])

    return run


def repeated_starts(rows: DataFrame, scratch: Scratch, length: int = LENGTH, spread: int = SPREAD, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """t1, t2, marks (array of struct lo, hi: first and last of a run of starts). rows: rid, text, t1, t2 (the text's fingerprint)."""
    long = rows.filter(F.octet_length("text") >= length)
    keys = long.select("text", "t1").mapInArrow(_key_rows(length, spread), "key bigint, code bigint")
    keys = scratch.keep(keys.groupBy("key").agg(F.min("code").alias("low"), F.max("code").alias("high")).filter("low < high").select("key"))
    scratch.release()
    found = long.select("text", "t1", "t2").mapInArrow(_segment_rows(length, spread), "t1 bigint, t2 bigint, key bigint, seg bigint, anchor bigint, first bigint, last bigint")
    found = scratch.keep(found.join(keys, "key", "left_semi").groupBy("t1", "t2", "anchor").agg(*[F.min(c).alias(c) for c in ("key", "seg", "first", "last")]))
    scratch.release()
    place = F.struct("t1", "t2", "anchor", "first", "last")
    distinct = found.groupBy("key", "seg").agg(F.min(place).alias("home"), F.max(place).alias("other"))
    distinct = scratch.keep(distinct.withColumn("multi", F.col("home") != F.col("other")).drop("other"))
    width = distinct.groupBy("key").agg(F.count("*").alias("width"))
    wanted = distinct.join(width.filter("width > 1"), "key").select("home.*", "key", "seg", (F.col("width") > hot_segments).alias("hot"), F.pmod("home.t1", F.lit(BATCHES)).alias("batch"))
    wanted = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("key", "seg", "hot", "batch", "first", "last")).alias("wanted"))
    homes = rows.groupBy("t1", "t2").agg(F.min("rid").alias("rid")).join(wanted, ["t1", "t2"]).select("rid", "wanted")
    data = rows.select("rid", "text").join(homes, "rid").select("text", "wanted").mapInArrow(_cut(length), "key bigint, seg bigint, hot boolean, batch bigint, data binary")
    data = scratch.keep(data.dropDuplicates(["key", "seg"]))
    scratch.release()
    cold = data.filter(~F.col("hot")).select("key", "batch", "seg", "data").repartition("key").sortWithinPartitions("key", "batch")
    cold = cold.mapInArrow(_index(length), "seg bigint, marks array<struct<lo:bigint,hi:bigint>>")
    windows = data.filter("hot").select("seg", "data").mapInArrow(_windows(length), "window bigint, seg bigint, start bigint")
    code = F.xxhash64("seg", "start")
    twice = windows.groupBy("window").agg(F.min(code).alias("low"), F.max(code).alias("high")).filter("low < high").select("window")
    hot = windows.join(twice, "window", "left_semi").groupBy("seg").agg(F.collect_set(F.struct(F.col("start").alias("lo"), F.col("start").alias("hi"))).alias("marks"))
    marks = scratch.keep(cold.unionByName(hot).groupBy("seg").agg(F.flatten(F.collect_list("marks")).alias("marks")))
    scratch.release()
    multi = distinct.filter("multi").select("seg", F.lit(True).alias("multi")).distinct()
    known = multi.join(marks, "seg", "full")
    # A segment of very many texts is dealt to many places.
    salt = F.pmod("t1", F.lit(SALTS)).alias("salt")
    told = found.select("seg", salt).distinct().join(known, "seg")
    placed = found.withColumn("salt", salt).join(told, ["seg", "salt"])
    shifted = F.transform("marks", lambda m: F.struct((m["lo"] + F.col("first")).alias("lo"), (m["hi"] + F.col("first")).alias("hi")))
    whole = F.array(F.struct(F.col("first").alias("lo"), F.col("last").alias("hi")))
    placed = placed.withColumn("marks", F.when(F.col("multi"), whole).otherwise(shifted)).filter(F.col("marks").isNotNull())
    return placed.groupBy("t1", "t2").agg(F.flatten(F.collect_list("marks")).alias("marks"))


def spans_of(size: int, marks: list[tuple[int, int]], copied: bool, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs (start, length)."""
    if copied:
        return [(0, size)] if size >= length else []
    out: list[list[int]] = []
    for lo, hi in sorted(marks):
        end = hi + length
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([lo, end])
    return [(a, b - a) for a, b in out]


def _result(text: Column, marks: Column, copied: Column, length: int) -> Column:
    @F.arrow_udf(RESULT)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        span = pa.struct([("start", pa.int64()), ("len", pa.int64())])
        for texts, marked, copies in batches:
            sizes, spans, kept = [], [], []
            for t, m, c in zip(texts, marked, copies):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                own = spans_of(len(raw), [(x["lo"], x["hi"]) for x in m.as_py() or ()], bool(c.as_py()), length)
                edges = [0, *(e for s, n in own for e in (s, s + n)), len(raw)]
                sizes.append(len(raw))
                spans.append([{"start": s, "len": n} for s, n in own])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], names=["n_bytes", "spans", "kept"]
            )

    return run(text, marks, copied)


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", into: str = "found", length: int = LENGTH, spread: int = SPREAD, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """Documents with a struct column ``into``: n_bytes, spans (removed runs) and kept (the remaining bytes)."""
    spark = session_of(documents)
    ship(spark)
    scratch = Scratch(spark)
    t1, t2 = F.xxhash64(F.col(text)), F.xxhash64(F.lit("\u0001"), F.col(text))
    rows = pick(documents, key, text).filter(F.col(text).isNotNull())
    rows = rows.select(F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("rid"), F.col(text).alias("text"), t1.alias("t1"), t2.alias("t2"))
    marks = repeated_starts(rows, scratch, length, spread, hot_segments)
    copies = rows.groupBy("t1", "t2").agg(F.count("*").alias("n")).filter("n > 1").select("t1", "t2", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>").alias("marks"), F.lit(True).alias("copied"))
    known = marks.withColumn("copied", F.lit(False)).unionByName(copies).groupBy("t1", "t2").agg(F.flatten(F.collect_list("marks")).alias("__marks"), F.max("copied").alias("__copied"))
    known = scratch.keep(known.withColumnsRenamed({"t1": "__t1", "t2": "__t2"}))
    scratch.release()
    out = documents.withColumn("__t1", t1).withColumn("__t2", t2).join(known, ["__t1", "__t2"], "left")
    return out.withColumn(into, _result(F.col(text), F.col("__marks"), F.col("__copied"), length)).drop("__t1", "__t2", "__marks", "__copied")


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
    removed = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s["len"])
    return out.select(
        "doc_id", F.col("found.n_bytes").alias("n_bytes"), removed.alias("n_removed"), F.size("found.spans").cast("long").alias("n_spans"),
        F.sha2(F.col("found.kept"), 256).alias("kept_sha256"),
    )
