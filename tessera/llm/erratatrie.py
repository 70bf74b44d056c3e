"""Spelling variants: words that differ by one inserted, deleted or replaced character, by merging an errata trie.

Words form a trie. At each branching node the child with the most words is heavy, the others are light, so that a word lies
in at most log2(words) light subtrees. The tries of errors come from merging light subtrees, small to large:

* a light subtree, its first character replaced by the heavy one, is merged into the heavy subtree;
* a light subtree, its first character skipped, is merged into the node's own subtree;
* a light subtree, behind a further heavy character, is merged into the heavy subtree (the heavy one skipped);
* light subtrees of a node, their first characters skipped, are merged with each other;
* the end of a word counts as a light child: a word without its last character is merged into its parent node.

Terminals that coincide are words one edit apart. Each pair coincides once: replacements at their place, and skips at the
last of equal characters in a row.

As tables: nodes are known by a 128-bit hash of their prefix, rolled along each word, and child sizes are counted by
(node, character), with sums in each task before the shuffle. Light edges with over ``LARGE`` words are fewer than
the characters of all words by ``LARGE`` and are broadcast; the others hold at most ``LARGE`` words and are joined by a shuffle.
Merging is a join of the changed word with the words themselves, whose keys are strings of all kinds, so no node is a hot
group. Light subtrees with skipped characters meet by (prefix, rest), of which there are at most as many as characters; the
counts and the two best of such a group stand for its pairs.

Counts cover all texts. A null text has no words; a null id alters none of its words. Repeated rows count as often as they
stand. Ties for a word's form go to the smallest word by code points. Columns of other names don't matter; an empty table
gives no rows. Words of any length are whole: a prefix is never stored, only its hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, pick, session_of, ship

RUN = r"[A-Za-z\x{C0}-\x{FF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARACTERS, LEAST_COUNT, EVERY, TIMES, LARGE = 6, 5, 199, 5, 100_000
PRIME, BASE = (1 << 127) - 1, 0x5BD1E995_9E3779B9_7F4A7C15_F39CC061


def lowered(run: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    ascii_only = F.octet_length(run) == F.length(run)
    return F.when(ascii_only, F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def altered(run: Column, key: Column, every: int = EVERY) -> Column:
    """The run, but for one in ``every`` keyed runs, which lose a character."""
    h = F.crc32(F.concat(key.cast("string"), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY, least_characters: int = LEAST_CHARACTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of enough characters and occurrences. Runs that are too short are left out first; altering only shortens."""
    runs = pick(docs, key, text).select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.filter(F.length("run") >= least_characters).select("key", lowered(F.col("run")).alias("run")).select(altered(F.col("run"), F.col("key"), every).alias("word"))
    return words.filter(F.length("word") >= least_characters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each character of each word: the word's id, the place, the node above and the character."""
    names = ["id", "at", "node", "c"]
    for batch in batches:
        ids, places, nodes, characters = [], [], [], []
        for i, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h = 1
            for at, c in enumerate(word):
                ids.append(i)
                places.append(at)
                nodes.append(h.to_bytes(16, "big"))
                characters.append(c)
                h = (h * BASE + ord(c)) % PRIME
            if len(ids) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(nodes, pa.binary()), pa.array(characters, pa.string())], names=names)
                ids, places, nodes, characters = [], [], [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(nodes, pa.binary()), pa.array(characters, pa.string())], names=names)


def light_edges(edges: DataFrame) -> DataFrame:
    """node, c, heavy, size: the light children of branching nodes, each with its heavy sibling's character."""
    children = edges.groupBy("node", "c").agg(F.count("*").alias("size"))
    order = Window.partitionBy("node").orderBy(F.desc("size"), "c")  # one row for each character
    ranked = children.withColumn("nth", F.row_number().over(order)).withColumn("heavy", F.first("c").over(order))
    return ranked.filter(F.col("nth") > 1).select("node", "c", "heavy", "size")


def light_places(words: DataFrame, large: int, scratch: Scratch) -> DataFrame:
    """id, word, n, at, heavy: each word at its light edges."""
    edges = words.select("id", "word").mapInArrow(_edges, "id bigint, at int, node binary, c string")
    light = scratch.keep(light_edges(edges))
    few = edges.join(F.broadcast(light.filter(F.col("size") > large).drop("size")), ["node", "c"])
    many = edges.join(light.filter(F.col("size") <= large).drop("size"), ["node", "c"])
    return few.unionByName(many).select("id", "at", "heavy").join(words, "id")


def better(n: str, word: str) -> Column:
    """What is least for the word of the largest count, ties to the smallest word."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))


def neighbours(words: DataFrame, scratch: Scratch, large: int = LARGE) -> DataFrame:
    """word, n_near, best (less, word): how many words are near a word, and the best of them."""
    places = scratch.keep(light_places(words, large, scratch))
    before, c, rest = F.expr("substr(word, 1, at)"), F.expr("substr(word, at + 1, 1)"), F.expr("substr(word, at + 2)")
    replaced = F.concat(before, "heavy", rest)
    skipped = F.when((rest != "") & (F.substr(rest, F.lit(1), F.lit(1)) != c), F.concat(before, rest))
    longer = F.concat(before, "heavy", c, rest)
    changed = places.select("word", "n", F.explode(F.array(replaced, skipped, longer)).alias("other")).filter("other is not null")
    ends = words.select("word", "n", F.expr("substr(word, 1, length(word) - 1)").alias("other"))
    met = changed.unionByName(ends).join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    both = F.array(F.struct(F.col("word").alias("word"), better("m", "other").alias("best")), F.struct(F.col("other").alias("word"), better("n", "word").alias("best")))
    pairs = met.select(F.explode(both).alias("x")).select("x.word", F.lit(1).cast("long").alias("near"), "x.best")
    siblings = places.select("word", "n", before.alias("before"), rest.alias("rest"))
    group = Window.partitionBy("before", "rest")  # one row for each character
    ranked = siblings.withColumn("size", F.count("*").over(group)).filter("size > 1")
    order = group.orderBy(F.desc("n"), "word")
    ranked = ranked.withColumn("first", F.first(better("n", "word")).over(order)).withColumn("second", F.nth_value(better("n", "word"), 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    beside = ranked.select("word", (F.col("size") - 1).alias("near"), F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first")).alias("best"))
    return pairs.unionByName(beside).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root: forms followed to the last. Counts grow ``TIMES``-fold along a chain, so it is short, and each round doubles the step."""
    links = scratch.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        up = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch.keep(links.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not step.filter("moved").isEmpty()
        links = step.drop("moved")
        if not moved:
            return links


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY, least_characters: int = LEAST_CHARACTERS, least_count: int = LEAST_COUNT, times: int = TIMES, large: int = LARGE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every counted word."""
    spark = session_of(docs)
    ship(spark)
    scratch = Scratch(spark)
    words = scratch.keep(counted(docs, key, text, every, least_characters, least_count).withColumn("id", F.monotonically_increasing_id()))
    near = scratch.keep(neighbours(words, scratch, large))
    own = words.select("word", "n").join(near, "word", "left")
    form_n = -F.col("best.less")
    fits = form_n >= times * F.col("n")
    told = scratch.keep(own.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, form_n).alias("form_n")))
    last = roots(told.filter("form is not null"), scratch)
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_variants(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# The checksum's table is made of its polynomial; then words, deletions with their places, and pairs that share one.
OP11_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) t),
d AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+') ws FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run, count(*) k FROM (SELECT doc_id, unnest(ws) w FROM d) WHERE length(w) >= 6 GROUP BY ALL),
b AS (SELECT run, k, list_transform(range(1, octet_length(encode(doc_id || ':' || run)) + 1), lambda i: ('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * i - 1, 2))::BIGINT) bytes FROM r),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t.t[(xor(c, x) & 255) + 1])), 4294967295) h FROM b, t),
a AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT n FROM a WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
x AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) i FROM w)),
p AS (SELECT p.word, q.word other, q.n m FROM x p JOIN x q ON p.i = q.i AND p.cut = q.cut AND p.word <> q.word
  UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.cut = w.word UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.cut = w.word),
f AS (SELECT w.word, any_value(n) n, count(other) n_near, arg_min(other, (-m, other)) best, max(m) best_n FROM w LEFT JOIN p ON w.word = p.word GROUP BY 1),
g AS (SELECT word, n, n_near, CASE WHEN best_n >= 5 * n THEN best END form, CASE WHEN best_n >= 5 * n THEN best_n END form_n FROM f),
up AS (SELECT word, word root, 0 step FROM g UNION ALL SELECT up.word, g.form, step + 1 FROM up JOIN g ON g.word = up.root WHERE g.form IS NOT NULL)
SELECT g.word, form, arg_max(root, step) root, any_value(n) n, any_value(n_near) n_near, any_value(form_n) form_n FROM g JOIN up ON g.word = up.word GROUP BY ALL"""
