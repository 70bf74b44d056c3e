"""Phrase collocations: identical pieces become multiplicities, weighted n-grams are counted out-of-core by hash bucket,
and the counts of a phrase's parts come by shuffled lookup requests.

1. ``pieces``: texts are lower-cased (A-Z), cut into pieces of words, and equal pieces of a language become one row with a weight.
2. ``grams``: one length after the other. A task counts the weighted n-grams of a few megabytes of pieces at a time in duckdb, as
   numbers; the counts are shuffled by (language, n-gram) into buckets, and each bucket is counted by duckdb from a stream, with
   bounded memory and what doesn't fit in the task's own temporary folder (deleted when the task ends; nothing else reads it).
   n-grams of fewer than ``LEAST`` occurrences go. As no n-gram is more frequent than its parts, the longer ones are only
   counted where all their shorter parts may be frequent: ``Filter``, a hash of ``FILTER_BITS`` bits for each length, tells so. Its
   size is fixed; it lets through what it can't tell, so at any size the counts are exact.
3. ``scored``: every way to cut a candidate sends two requests, (language, part); they are shuffled to the parts' counts, which
   stand once for each part, and the replies are shuffled to the candidates. Much requested parts are a join's skewed
   keys, which adaptive execution splits, as their other side is a single row.
4. ``uncovered`` drops candidates that a longer one holds often enough; ``best`` ranks each language in two steps, first within
   salted parts.

Counts cover all rows. A null text is empty, a null language is ``und``. Repeated rows count as often as they stand. Arithmetic is
exact: scores are integer divisions of decimals of 38 digits, enough for counts up to 10^15. Ties: lowest score, then smallest cut;
score, count, phrase. Columns of other names don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import math
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, pick, session_of, ship

LONGEST, LEAST, SHARE, MOST, UNKNOWN = 3, 10, 50, 2000, "und"
FILTER_BITS, CHUNK_BYTES, BUCKET_BYTES, MEMORY = 1 << 26, 8 << 20, 256 << 20, "256MB"
#: Ends of pieces become a new line, tabs a space, A-Z a-z.
PIECE_BYTES = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c | 32 if 65 <= c <= 90 else c for c in range(256))


def duck(folder: str | None = None, memory: str = MEMORY):
    import duckdb

    config = {"threads": 1, "memory_limit": memory, "preserve_insertion_order": False} | ({"temp_directory": folder} if folder else {})
    return duckdb.connect(config=config)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            for piece in text.translate(PIECE_BYTES).split(b"\n"):
                if words := piece.split():  # of bytes, so only at ASCII white space, of which spaces are left
                    found[lang, b" ".join(words), len(words)] += 1
        rows = list(found.items())
        for i in range(0, len(rows), 20_000):
            part = rows[i : i + 20_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in part], pa.string()), pa.array([k[1] for k, _ in part], pa.binary()).cast(pa.string()), pa.array([k[2] for k, _ in part], pa.int64()), pa.array([n for _, n in part], pa.int64())],
                names=["lang", "piece", "words", "weight"],
            )


def pieces(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, piece (words with single spaces), words, weight: the different pieces of each language."""
    rows = pick(docs, lang, text).select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = rows.mapInArrow(_pieces, "lang string, piece string, words bigint, weight bigint")
    return own.groupBy("lang", "piece", "words").agg(F.sum("weight").alias("weight"))


class Filter:
    """Which n-grams of a length may be frequent: a bit for each hash."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def allows(self, con, lang: pa.Array, gram: pa.Array) -> np.ndarray:
        if not len(gram):
            return np.zeros(0, bool)
        h = hashes(con, lang, gram) % np.uint64(len(self.bits) * 64)
        return (self.bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def hashes(con, lang: pa.Array, gram: pa.Array) -> np.ndarray:
    con.register("hashed", pa.table({"lang": lang, "gram": gram}))
    return con.sql("SELECT hash(lang, gram) AS h FROM hashed").to_arrow_table()["h"].to_numpy()


def filter_of(frequent: DataFrame, bits: int) -> Filter:
    """The filter of n-grams; its bits are united by Spark and come to the driver, ``bits`` by 8 bytes and no more."""
    slots = bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, own = duck(), np.zeros(slots, np.uint64)
        for batch in batches:
            if batch.num_rows:
                h = hashes(con, batch.column(0), batch.column(1)) % np.uint64(bits)
                np.bitwise_or.at(own, (h >> np.uint64(6)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
        there = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(own[there].view(np.int64))], names=["slot", "bits"])

    rows = frequent.select("lang", "gram").mapInArrow(run, "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(slots, np.int64)
    out[rows["slot"].to_numpy()] = rows["bits"].to_numpy()
    return Filter(out.view(np.uint64))


def count_chunk(con, chunk: pa.Table, length: int, filters: list[Filter]) -> pa.Table:
    """lang, gram, n: the n-grams of one length in a chunk of pieces, those that the filters of shorter lengths rule out left out."""
    split = pc.split_pattern(chunk["piece"].combine_chunks(), " ")
    sizes = np.diff(split.offsets.to_numpy())
    flat, lang = split.flatten().dictionary_encode(), chunk["lang"].combine_chunks().dictionary_encode()
    words, langs = flat.dictionary, lang.dictionary
    piece = np.repeat(np.arange(len(sizes)), sizes)
    weight = chunk["weight"].to_numpy()[piece]
    together = lang.indices.to_numpy()[piece].astype(np.int64) * len(words) + flat.indices.to_numpy()
    known, place = np.unique(together, return_inverse=True)  # words apart by language
    gram, tongue, last = words.take(pa.array(known % len(words))), langs.take(pa.array(known // len(words))), words.take(pa.array(known % len(words)))
    for n in range(1, length):
        allowed = filters[n - 1].allows(con, tongue, gram)
        place = np.where((place >= 0) & allowed[place], place, -1)
        both = np.flatnonzero((place[:-1] >= 0) & (place[1:] >= 0) & (piece[:-1] == piece[1:])) if len(place) > 1 else np.zeros(0, np.int64)
        pair, at = np.unique(place[both] * len(gram) + place[both + 1], return_inverse=True)
        a, b = pa.array(pair // max(1, len(gram))), pa.array(pair % max(1, len(gram)))
        gram, tongue, last = pc.binary_join_element_wise(gram.take(a), last.take(b), " "), tongue.take(a), last.take(b)
        place = np.full(len(place), -1)
        place[both] = at
    there = place >= 0
    con.register("places", pa.table({"place": place[there], "weight": weight[there]}))
    counts = con.sql("SELECT place, sum(weight)::BIGINT AS n FROM places GROUP BY place").to_arrow_table()
    return pa.table({"lang": tongue.take(counts["place"]), "gram": gram.take(counts["place"]), "n": counts["n"]})


def _partial(length: int, filters, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, held, size = duck(), [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= chunk_bytes:
                yield from count_chunk(con, pa.Table.from_batches(held), length, filters.value).to_batches(20_000)
                held, size = [], 0
        if size:
            yield from count_chunk(con, pa.Table.from_batches(held), length, filters.value).to_batches(20_000)

    return run


def _whole(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
        with tempfile.TemporaryDirectory() as folder:
            con = duck(folder)
            con.register("bucket", pa.RecordBatchReader.from_batches(schema, (b.cast(schema) for b in batches)))
            counts = con.sql(f"SELECT lang, gram, sum(n)::BIGINT AS n FROM bucket GROUP BY ALL HAVING sum(n) >= {int(least)}").to_arrow_reader(20_000)
            for batch in counts:
                yield batch.cast(schema)
            con.close()

    return run


def grams(found: DataFrame, scratch: Scratch, longest: int = LONGEST, least: int = LEAST, bits: int = FILTER_BITS, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """lang, gram, n, length of all n-grams of up to ``longest`` words that stand ``least`` times in a language. found: kept pieces."""
    spark = session_of(found)
    size = found.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-3 * size // bucket_bytes))
    filters, levels = [], []
    for length in range(1, longest + 1):
        shared = spark.sparkContext.broadcast(list(filters))
        partial = found.select("lang", "piece", "weight").mapInArrow(_partial(length, shared, chunk_bytes), "lang string, gram string, n bigint")
        frequent = scratch.keep(partial.repartition(buckets, "lang", "gram").mapInArrow(_whole(least), "lang string, gram string, n bigint"))
        scratch.release()
        levels.append(frequent.withColumn("length", F.lit(length)))
        if length < longest:
            filters.append(filter_of(frequent, bits))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def part(words: Column | str, begin: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, begin, size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, length, a, k, l, r, score of each candidate's lowest-scoring cut."""
    long = counts.filter("length > 1").select("lang", F.col("gram").alias("phrase"), "length", F.col("n").alias("a"), F.split("gram", " ").alias("w"))
    cuts = long.select("lang", "phrase", "length", "a", "w", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(True).alias("first"), part("w", F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("first"), part("w", F.col("k") + 1, F.col("length") - F.col("k")).alias("part")))
    requests = cuts.select("lang", "phrase", "length", "a", "k", F.explode(sides).alias("side")).select("lang", "phrase", "length", "a", "k", "side.first", "side.part")
    replies = requests.join(counts.select("lang", F.col("gram").alias("part"), "n"), ["lang", "part"]).repartition("lang", "phrase")
    both = replies.groupBy("lang", "phrase", "length", "a", "k").agg(F.max(F.when(F.col("first"), F.col("n"))).alias("l"), F.max(F.when(~F.col("first"), F.col("n"))).alias("r"))
    wide = both.select("*", *[F.col(c).cast("decimal(18,0)").alias(f"__{c}") for c in "alr"])
    told = wide.withColumn("score", F.expr("(__a * __a * 1000000BD) div (__l * __r)"))
    return told.groupBy("lang", "phrase", "length", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "length", "a", "cut.k", "cut.l", "cut.r", "cut.score")


def uncovered(candidates: DataFrame, share: int = SHARE) -> DataFrame:
    """Candidates that no longer one holds with ``share`` percent of their count or more; longer ones count whether dropped or not."""
    long = candidates.filter("length > 2").select("lang", "length", "a", F.split("phrase", " ").alias("w"))
    inner = long.select("lang", "w", "length", "a", F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("size"))
    inner = inner.select("lang", "w", "size", "a", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1)).alias("begin"))
    covers = inner.select("lang", part("w", F.col("begin"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("__most"))
    return candidates.join(covers, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("__most") < share * F.col("a"), F.lit(True))).drop("__most")


def best(candidates: DataFrame, most: int = MOST) -> DataFrame:
    """The first ``most`` of each language with their rank; of salted parts first, as many as make either step's groups alike in size."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salts = max(1, math.isqrt(candidates.count() // most))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    first = candidates.withColumn("__salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).filter(F.col("rank") <= most)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return last.filter(F.col("rank") <= most).drop("__salt")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, share: int = SHARE, most: int = MOST, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    spark = session_of(docs)
    ship(spark)
    scratch = Scratch(spark)
    found = scratch.keep(pieces(docs, lang, text))
    scratch.release()
    totals = found.groupBy("lang").agg(F.sum(F.col("words") * F.col("weight")).alias("n"))
    counts = grams(found, scratch, longest, least, **options)
    candidates = scratch.keep(uncovered(scored(counts), share))
    top = best(candidates, most).join(totals, "lang")
    return top.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT n FROM w GROUP BY 1),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') gram, count(*) f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) i FROM w, (SELECT unnest([1, 2, 3]) k)) GROUP BY ALL),
c AS (SELECT lang, k size, gram phrase, f a, string_split(gram, ' ') w FROM g WHERE k > 1 AND f >= 10),
cut AS (SELECT c.*, x.k, array_to_string(w[1:x.k], ' ') l, array_to_string(w[x.k + 1:], ' ') r FROM c, (SELECT unnest([1, 2]) k) x WHERE x.k < size),
s AS (SELECT cut.lang, phrase, size, a, cut.k, gl.f l, gr.f r, (a::HUGEINT * a * 1000000) // (gl.f::HUGEINT * gr.f) score FROM cut JOIN g gl ON gl.lang = cut.lang AND gl.gram = cut.l JOIN g gr ON gr.lang = cut.lang AND gr.gram = cut.r),
o AS (SELECT lang, phrase, size, a, min((score, k, l, r)) m FROM s GROUP BY ALL),
h AS (SELECT lang, part, max(a) most FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) part FROM c WHERE size = 3) GROUP BY ALL),
f AS (SELECT o.*, m[1]::BIGINT score FROM o LEFT JOIN h ON h.lang = o.lang AND part = phrase AND size = 2 WHERE most IS NULL OR 100 * most < 50 * a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) rank FROM f)
SELECT t.lang, rank, phrase, a, m[3]::BIGINT l, m[4]::BIGINT r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000"""
