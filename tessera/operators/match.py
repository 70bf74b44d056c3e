"""Entity matching in queries (M1-M9)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.cluster import Workspace, few, send_package

SHORT, FUZZY_CHARS, FUZZY_RATIO, FUZZY_TOP = 3, 6, 85, 3
# Names that are common English words and count in code context only.
AMBIGUOUS = ("$options", "component", "components", "data", "h", "inject", "is", "key", "methods", "name", "props", "provide", "render", "slot", "template", "watch")
BROADCAST_NAMES, BROADCAST_SETS = 100_000, 10_000
SHARD_BYTES = 512 << 10  # of phrases in an automaton, which takes about two hundred times that
PRIORITY = {"exact": 0, "bigram": 1, "synonym": 2, "fuzzy": 3}


def normalise(query: Column) -> Column:
    """M1."""
    return F.replace(F.trim(F.lower(query)), F.lit("`"), F.lit(""))


def query_tokens(query: Column) -> Column:
    """M2."""
    return F.filter(F.split(normalise(query), r"[\s\-_.,;:!?()]+"), lambda x: x != "")


def code_names(query: Column) -> Column:
    """M3: names in backticks, ``v-x``, ``<x`` and ``.x``, lower case."""
    quoted = F.regexp_extract_all(query, F.lit("`([^`]+)`"), F.lit(1))
    found = F.concat(
        quoted, F.transform(quoted, lambda x: F.regexp_replace(x, "^v-", "")), F.regexp_extract_all(query, F.lit(r"(?<![\w-])v-([\w-]+)"), F.lit(1)),
        F.regexp_extract_all(query, F.lit(r"<([\w-]+)"), F.lit(1)), F.regexp_extract_all(query, F.lit(r"(?<=\W)\.([\w$]+)"), F.lit(1)),
    )
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.trim(x))))


def _bounded(name: Column, text: Column) -> Column:
    """Is the name in the text between non-word characters?"""
    quoted = F.concat(F.lit(r"(?<![\w])\Q"), name, F.lit(r"\E(?![\w])"))
    return F.regexp_like(text, quoted)


class Automaton:
    """An Aho-Corasick automaton: a trie of phrases whose nodes know the longest other phrase's start that ends there too."""

    def __init__(self, phrases: list[str]):
        self.step: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]  # the phrase that ends at a node
        self.phrases = phrases
        for i, phrase in enumerate(phrases):
            node = 0
            for c in phrase:
                if c not in self.step[node]:
                    self.step[node][c] = len(self.step)
                    self.step.append({})
                    self.ends.append(-1)
                node = self.step[node][c]
            self.ends[node] = i
        self.fall, self.next_end = [0] * len(self.step), [0] * len(self.step)
        queue = list(self.step[0].values())
        for node in queue:  # by depth, as children are put at the end
            for c, child in self.step[node].items():
                back = self.fall[node]
                while back and c not in self.step[back]:
                    back = self.fall[back]
                self.fall[child] = self.step[back].get(c, 0)
                queue.append(child)
            back = self.fall[node]
            self.next_end[node] = back if self.ends[back] >= 0 else self.next_end[back]

    def found(self, text: str) -> set[int]:
        """The phrases that stand in a text, in one pass over it."""
        node, out, seen = 0, set(), set()
        step, fall = self.step, self.fall
        for c in text:
            while node and c not in step[node]:
                node = fall[node]
            node = step[node].get(c, 0)
            if node in seen:
                continue
            seen.add(node)
            end = node
            while end:
                if self.ends[end] >= 0:
                    out.add(self.ends[end])
                end = self.next_end[end]
        return out


def shards(phrases: DataFrame, most_bytes: int) -> Iterator[list[str]]:
    """Phrases in parts of bounded size; the driver holds one part at a time."""
    held, size = [], 0
    for (phrase,) in phrases.toLocalIterator():
        held.append(phrase)
        size += len(phrase) + 16
        if size >= most_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _found(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value)
        for batch in batches:
            rows, names = [], []
            for i, text in enumerate(batch.column(at).to_pylist()):
                for k in automaton.found(text or ""):
                    rows.append(i)
                    names.append(automaton.phrases[k])
            for i in range(0, len(rows), 20_000):
                part = batch.take(pa.array(rows[i : i + 20_000], pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[i : i + 20_000], pa.string())], names=[*part.schema.names, "__low"])

    return run


def contained(queries: DataFrame, phrases: DataFrame, phrase: str, most_bytes: int = SHARD_BYTES) -> DataFrame:
    """Pairs of queries and phrases that stand in them, in any case. Phrases make automata of bounded size, each of which passes over the
    queries once; with more than one, each one's pairs are written before the next is made. What a phrase stands for is joined to the pairs,
    which are never the side that is broadcast."""
    spark = queries.sparkSession
    send_package(spark)
    own = queries.withColumn("__q", normalise(F.col("text")))
    low = F.lower(F.col(phrase))
    known = phrases.filter(F.length(phrase) > 0).withColumn("__low", low)
    side = few(known, BROADCAST_NAMES)
    out, before, work = None, None, None
    schema = T.StructType([*own.schema.fields, T.StructField("__low", T.StringType())])
    for shard in shards(known.select("__low").distinct(), most_bytes):
        if before is not None:
            work = work or Workspace(spark)
            kept = work.keep(before)
            out = kept if out is None else out.unionByName(kept)
        before = own.mapInArrow(_found(spark.sparkContext.broadcast(shard), own.columns.index("__q")), schema)
    if before is None:
        return own.limit(0).withColumn("__low", F.lit("")).join(known, "__low")
    return (before if out is None else out.unionByName(before)).join(side, "__low")


def exact(queries: DataFrame, names: DataFrame) -> DataFrame:
    """M4: names that stand in the query."""
    joined = contained(queries, names.select("name").distinct(), "name")
    fits = F.when(F.length("name") <= SHORT, _bounded(F.col("__low"), F.col("__q"))).otherwise(F.lit(True))
    fits &= ~F.col("__low").isin(*AMBIGUOUS) | F.array_contains(code_names(F.col("text")), F.col("__low"))
    return joined.filter(fits).select("query", "name")


def bigram(queries: DataFrame, names: DataFrame) -> DataFrame:
    """M5: two tokens in a row make a name. Pairs that are no name go before any shuffle where names are few."""
    words = queries.select("query", query_tokens(F.col("text")).alias("w")).filter(F.size("w") > 1)
    pairs = words.select("query", F.explode(F.zip_with(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w) - 1)"), lambda a, b: F.concat(a, b))).alias("low"))
    known = few(names.select("name", F.lower("name").alias("low")).filter("low is not null"), BROADCAST_NAMES)
    return pairs.join(known.select("low").distinct(), "low", "left_semi").distinct().join(known, "low").select("query", "name")


def alias_sets(queries: DataFrame, synonyms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """query, lows: the phrases that stand in each query, kept as a table; lows, names: the different names of each different set of phrases,
    which are few where queries are many."""
    known = synonyms.filter(F.length("alias") > 0).select(F.lower("alias").alias("low"), "names")
    pairs = contained(queries, known.select(F.col("low").alias("alias")).distinct(), "alias")
    sets = Workspace(queries.sparkSession).keep(pairs.groupBy("query").agg(F.array_sort(F.collect_set("__low")).alias("lows")))
    each = sets.select("lows").distinct().select("lows", F.explode("lows").alias("low")).join(few(known, BROADCAST_NAMES), "low")
    told = each.groupBy("lows").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    return sets, few(told, BROADCAST_SETS)


def synonym(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """M6: phrases that stand in the query, with all names they stand for; only queries and phrases are shuffled, no names."""
    sets, told = alias_sets(queries, synonyms)
    return sets.join(told, "lows").select("query", F.explode("names").alias("name"))


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, by rows of the usual table."""
    start = F.transform(F.sequence(F.lit(0), F.length(b)), lambda i: F.lit(0))

    def row(before: Column, c: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            here = F.substr(b, j, F.lit(1)) == c
            value = F.when(here, F.element_at(before, j) + 1).otherwise(F.greatest(F.element_at(before, j + 1), F.element_at(done, -1)))
            return F.concat(done, F.array(value))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(F.split(a, ""), start, row), -1)


def ratio(a: Column, b: Column) -> Column:
    """Similarity of two strings from 0 to 100: 200 times their common length by the sum of their lengths."""
    return 200.0 * common_length(a, b) / (F.length(a) + F.length(b))


def pairs_of(text: str) -> Column:
    """Every two characters in a row, with their place."""
    return F.posexplode(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substr(F.col(text), i, F.lit(2)))).alias("__at", "__two")


def near(queries: DataFrame, names: DataFrame) -> DataFrame:
    """query, token, name, ratio: long tokens that nearly are a name.

    Strings of a and b characters that are alike enough differ by at most 15 % of a + b characters, so they share two characters in a row at
    nearly the same place: those pairs are joined. Length and edit distance rule most of them out before they are compared.
    """
    words = queries.select("query", F.explode(F.array_distinct(query_tokens(F.col("text")))).alias("token")).filter(F.length("token") >= FUZZY_CHARS)
    known = names.select("name", F.lower("name").alias("low")).filter((F.length("low") >= FUZZY_CHARS) & ~F.col("low").isin(*AMBIGUOUS)).distinct()
    most = F.floor((F.length("token") + F.length("low")) * (100 - FUZZY_RATIO) / 100).cast("int")
    left = words.select("token").distinct().select("token", pairs_of("token"))
    right = known.select("name", "low", pairs_of("low")).withColumnRenamed("__at", "__there")
    met = left.join(right, "__two").filter((F.abs(F.length("token") - F.length("low")) <= most) & (F.abs(F.col("__at") - F.col("__there")) <= most) & (F.col("token") != F.col("low")))
    met = met.select("token", "name", "low").distinct().filter(F.levenshtein("token", "low") <= most)
    met = met.withColumn("ratio", ratio(F.col("token"), F.col("low"))).filter(F.col("ratio") >= FUZZY_RATIO)
    return words.join(few(met, BROADCAST_NAMES), "token").select("query", "token", "name", "ratio")


def best(rows: DataFrame) -> DataFrame:
    """The nearest names of each token."""
    order = Window.partitionBy("query", "token").orderBy(F.desc("ratio"), "name")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= FUZZY_TOP).select("query", "name").distinct()


def fuzzy(queries: DataFrame, names: DataFrame, taken: DataFrame) -> DataFrame:
    """M7: the nearest names of long tokens, without those taken."""
    return best(near(queries, names).join(taken, ["query", "name"], "left_anti"))


def match(queries: DataFrame, names: DataFrame, synonyms: DataFrame) -> DataFrame:
    """M8: (query, name, source); the first method to claim a name has it. queries: query, text; synonyms: alias, names. What a query has found is
    one row until the end, so that names of synonyms are neither sorted nor shuffled one by one."""
    own = lambda rows, source: rows.select("query", F.lit(None).cast("array<string>").alias("lows"), F.struct("name", F.lit(PRIORITY[source]).alias("prio")).alias("f"))
    said = own(exact(queries, names), "exact").unionByName(own(bigram(queries, names), "bigram"))
    sets, told = alias_sets(queries, synonyms)
    both = said.unionByName(sets.select("query", "lows", F.lit(None).cast(said.schema["f"].dataType).alias("f")))
    held = both.groupBy("query").agg(F.flatten(F.collect_set("lows")).alias("lows"), F.array_sort(F.collect_set("f")).alias("f")).join(told, "lows", "left")
    # structs of one name stand in the order of their methods
    held = held.select("query", F.filter("f", lambda x, i: (i == 0) | (F.get(F.col("f"), i - 1)["name"] != x["name"])).alias("f"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))
    held = held.select("query", F.concat("f", F.transform(F.array_except("names", F.transform("f", lambda x: x["name"])), lambda x: F.struct(x.alias("name"), F.lit(PRIORITY["synonym"]).alias("prio")))).alias("f"))
    free = near(queries, names).join(held.hint("merge"), "query", "left").filter(~F.coalesce(F.exists("f", lambda x: x["name"] == F.col("name")), F.lit(False)))
    first = held.select("query", F.inline("f")).unionByName(best(free).select("query", "name", F.lit(PRIORITY["fuzzy"]).alias("prio")))
    return first.select("query", "name", F.element_at(F.array(*map(F.lit, PRIORITY)), F.col("prio") + 1).alias("source"))


def lookup(wanted: DataFrame, entities: DataFrame) -> DataFrame:
    """M9: by name, else by name in any case, the first in order. wanted: query, text."""
    both = wanted.join(entities, F.lower(F.trim("text")) == F.lower("name"))
    order = Window.partitionBy("query").orderBy((F.trim("text") != F.col("name")).cast("int"), "name")
    return both.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
