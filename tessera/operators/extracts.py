"""Extracts in place of written summaries and prefixes (N1, N3): the sentences nearest to their text's centroid.

A token's slot is its hash modulo ``SLOTS``. A slot weighs as many bits as ``documents // documents with the slot`` has, so weights, and the
products made of them, are whole numbers that don't depend on the order of sums. The centroid of a text holds, for each slot, its occurrences in the text
times its weight; a sentence scores the square of its product with the centroid over its own squared length. The best sentences are
joined in the order of the text.

Two passes over the texts and no shuffle of them: the first counts documents by slot, which tasks sum up before they are shuffled; the weights, one byte for
each slot (1 MB, whatever the corpus), go to all tasks; the second scores each text where it stands. In a corpus with many more words than slots,
rare words share slots and weigh a few bits less.

Defined results: a null text has a null extract, a text without sentences an empty one. Sentences end at ``.``, ``!``, ``?`` and line ends; of equal
ones the first counts. Those without tokens score 0. Ties go to the earlier sentence. Keys aren't looked at; repeated rows get an extract each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.cluster import send_package
from tessera.operators.bm25 import tokens

SLOTS = 1 << 20


def sentences(text: Column) -> Column:
    """The different sentences of a text in its order, without blank ends."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0)), lambda s: F.trim(s))
    return F.array_distinct(F.filter(found, lambda s: s != ""))


def slots_of(text: Column, slots: int, stop_words: list[str] | None = None) -> Column:
    """The slots of a text's tokens."""
    return F.transform(tokens(text, stop_words), lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int"))


def slot_weights(texts: DataFrame, text: str, slots: int, stop_words: list[str] | None = None) -> np.ndarray:
    """Bits of documents // those with a slot; 0 where there are none. Empty arrays go after they are exploded, as a filter that Spark infers makes them twice."""
    found = texts.select(F.explode_outer(F.array_distinct(F.flatten(F.transform(sentences(F.col(text)), lambda s: slots_of(s, slots, stop_words))))).alias("slot")).filter("slot is not null")
    counted = found.groupBy("slot").agg(F.count("*").alias("df")).toPandas()  # at most ``slots`` rows
    out = np.zeros(slots, np.uint8)
    share = texts.count() // counted["df"].to_numpy(np.int64)
    out[counted["slot"].to_numpy(np.int64)] = [int(x).bit_length() for x in share]
    return out


def best(own: list[np.ndarray], weights: np.ndarray, count: int) -> list[int]:
    """Places of the ``count`` best sentences, given the slots of each, in order."""
    scores = np.zeros(len(own))
    lengths = [len(s) for s in own]
    if sum(lengths):
        pairs, n = np.unique(np.repeat(np.arange(len(own)), lengths) * len(weights) + np.concatenate(own).astype(np.int64), return_counts=True)
        sentence, slot = np.divmod(pairs, len(weights))
        _, place = np.unique(slot, return_inverse=True)
        total = np.zeros(place.max() + 1, np.int64)
        np.add.at(total, place, n)
        square = weights[slot].astype(np.int64) ** 2
        begins = np.flatnonzero(np.diff(sentence, prepend=-1))
        product, size = np.add.reduceat(n * total[place] * square, begins).astype(float), np.add.reduceat(n * n * square, begins).astype(float)
        scores[sentence[begins]] = np.divide(product * product, size, out=np.zeros_like(product), where=size > 0)
    return sorted(np.argsort(-scores, kind="stable")[:count].tolist())


def extracts(rows: DataFrame, text: str, count: int = 2, into: str = "extract", stop_words: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``rows`` with the ``count`` best sentences of each text, joined by spaces."""
    send_package(rows.sparkSession)
    told = rows.sparkSession.sparkContext.broadcast(slot_weights(rows, text, slots, stop_words))

    @F.pandas_udf("array<int>")
    def picked(texts: pd.Series) -> pd.Series:
        return pd.Series([None if own is None else best(list(own), told.value, count) for own in texts])

    # sentences are a column before they are picked from, as inside a lambda they would be made anew for each one picked
    own = rows.withColumn("__own", sentences(F.col(text))).withColumn("__places", picked(F.transform("__own", lambda s: slots_of(s, slots, stop_words))))
    return own.withColumn(into, F.array_join(F.transform("__places", lambda i: F.get(F.col("__own"), i)), " ")).drop("__own", "__places")


def prefixes(chunks: DataFrame, text: str = "content", column: str = "contextual_prefix", **how) -> DataFrame:
    """A prefix from the best sentence for chunks that have none and whose type, if told, is one of those enriched."""
    from tessera.operators.summaries import prefixed

    made = extracts(chunks, text, 1, "__extract", **how)
    return prefixed(made, lambda _: F.col("__extract"), column).drop("__extract")
