"""Token counts by a byte-pair vocabulary (P32): what a model's own tokenizer would count.

The vocabulary is a public file of ranks, one token in base64 and its rank to a line; it is read by the driver and broadcast (about 1 MB), so executors needn't have
it. A coder is made once for each Python worker. Texts are counted whole, one after another; nothing is shuffled.

Defined results: null has a null count, the empty text 0. The strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.cluster import send_package

VOCABULARY = os.environ.get("TESSERA_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The byte-level vocabulary's pattern that splits text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def coder(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks={base64.b64decode(t): int(r) for t, r in pairs}, special_tokens={})


def counter(spark: SparkSession, vocabulary: str = VOCABULARY) -> Callable[[Column], Column]:
    """A function from a text column to its number of tokens."""
    send_package(spark)
    with open(vocabulary, "rb") as file:
        told = spark.sparkContext.broadcast(file.read())

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = coder(told.value).encode_ordinary
        for texts in batches:
            yield pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    return count
