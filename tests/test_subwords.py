"""Token counts against the public library's own, on all documents and odd texts."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import subwords

LIBRARY = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(LIBRARY)
    tokenizer.encode_special_tokens = True
    return lambda t: None if t is None else len(tokenizer.encode(t, add_special_tokens=False).ids)


def test_all_documents(spark, sf, library):
    rows = spark.read.parquet(f"{sf}/documents.parquet").withColumn("n", subwords.counter(spark)(F.col("text"))).collect()
    assert rows and [r.n for r in rows] == [library(r.text) for r in rows]


def test_odd_texts(spark, library):
    texts = [None, "", " ", "\n\n \t x  y ", "don't we'll", "naïve Straße 東京 عربى 🙂🙂", "<|endoftext|> in text", "1234 5,678.90", "a" * 20_000, "word " * 50_000, "\u0000  end", "naïve Straße"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("n", subwords.counter(spark)(F.col("text")))
    assert {r.k: r.n for r in rows.collect()} == {k: library(t) for k, t in enumerate(texts)}
    assert rows.limit(0).count() == 0
