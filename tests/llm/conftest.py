import json

import pytest

from tessera.llm.packing import byte_alphabet, vocabulary_path


@pytest.fixture(scope="session")
def vocabulary():
    return vocabulary_path()


@pytest.fixture
def documents(spark):
    """Nulls, empties, repeats, a long text, and columns whose names clash with those of the operators."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. It was a fine day in the old town, and nobody minded the noise at all.", 5),
        (1, "The quick brown fox jumps over the lazy dog. It was a fine day in the old town, and nobody minded the noise at all.", 5),
        (2, None, 6), (3, "", 7), (None, "no id here", 8), (4, " \n\t ", 9), (5, "word " * 6000, 10), (6, "ünïcode ßtraße 漢字 words", 11),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, node int").selectExpr("doc_id", "text", "node", "node AS label", "node AS TEXT_2", "node AS score")


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string")
