"""The default reranker (K20): how much of a query a hit covers, how close together, and how near their vectors are.

The cover of a text is its shortest run of words that holds every query word the text has. A hit's score is a mean, weighed by ``WEIGHTS``, of the share
of query words it has, of how dense they stand in the cover, and of the cosine of the vectors where there are any. It goes up from -0.5, as what has no
word of the query may still have been found through a question or a link, and isn't dropped for it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.cluster import send_package
from tessera.operators.bm25 import tokens
from tessera.operators.retrieval import dot, norm

WEIGHTS = {"share": 0.5, "density": 0.2, "cosine": 0.3}


def least_cover(words: list[str], asked: set[str]) -> tuple[int, int]:
    """How many of the asked words stand in the text, and the length of the shortest run with all of these: a window that moves over their places."""
    places = [(i, w) for i, w in enumerate(words) if w in asked]
    wanted, inside, best, begin = len({w for _, w in places}), {}, 0, 0
    for end, word in places:
        inside[word] = inside.get(word, 0) + 1
        while len(inside) == wanted:
            first, leaving = places[begin]
            best = min(best or end - first + 1, end - first + 1)
            inside[leaving] -= 1
            if not inside[leaving]:
                del inside[leaving]
            begin += 1
    return wanted, best


def _covers(words: pd.Series, asked: pd.Series) -> pd.DataFrame:
    found = [(0, 0) if w is None or a is None else least_cover(list(w), set(a)) for w, a in zip(words, asked)]
    return pd.DataFrame(found, columns=["matched", "length"])


def cover_score(hits: DataFrame, content: str = "content", text: str = "text") -> Column:
    """The score of hits with their chunks, the query's text and, where there are any, ``vec`` and ``qvec``."""
    send_package(hits.sparkSession)
    asked = F.array_distinct(tokens(F.col(text)))
    cover = F.pandas_udf(_covers, "struct<matched:int,length:int>")(tokens(F.col(content)), asked)
    share = F.when(F.size(asked) > 0, cover["matched"] / F.size(asked)).otherwise(0.0)
    density = F.when(cover["length"] > 0, cover["matched"] / cover["length"]).otherwise(0.0)
    parts, weights = [share * WEIGHTS["share"], density * WEIGHTS["density"]], WEIGHTS["share"] + WEIGHTS["density"]
    if {"vec", "qvec"} <= set(hits.columns):
        length = norm(F.col("vec")) * norm(F.col("qvec"))
        parts.append(F.coalesce(F.when(length > 0, dot(F.col("qvec"), F.col("vec")) / length), F.lit(0.0)) * WEIGHTS["cosine"])
        weights += WEIGHTS["cosine"]
    return F.round(F.greatest(F.lit(0.0), sum(parts[1:], parts[0]) / F.lit(weights)) * 1.5 - 0.5, 6)
