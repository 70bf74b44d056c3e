import corpus_pipeline as C
import pytest

from tessera.llm import decontaminate, orderminhash, surrogates
from tessera.llm.packing import vocabulary_path


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Each stage's result over its predecessor's, written and read again."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), {}
    for n, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{n}")
        out[name] = (docs, docs := spark.read.parquet(f"{folder}/{n}"))
    return out


def test_columns(stages):
    names = [n for n, _ in C.STAGES]
    for name in names[:-1]:
        before, after = stages[name]
        assert after.columns == before.columns


def test_quality_keeps_good_rows(spark, sf, stages):
    before, after = stages["quality classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) / len(good) > 0.97 and sum(d in kept for d in bad) / max(1, len(bad)) < 0.1


def test_one_of_each_class_stays(stages):
    before, after = stages["MinHash near-dedup"]
    classes = {r.doc_id: r.class_id for r in orderminhash.near_duplicates(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(classes.values()))


def test_contaminated_rows_go(spark, sf, stages):
    before, after = stages["benchmark decontamination"]
    found = decontaminate.search(before, spark.read.parquet(f"{sf}/benchmark.parquet")).withColumn("c", decontaminate.contaminated())
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in found.collect() if not r.c}


def test_personal_data_goes(stages):
    before, after = stages["PII"]
    old = {r.doc_id: r for r in surrogates.replace(before, C.SURROGATE_KEY, found="f").collect()}
    for r in after.collect():
        assert all(e.value not in r.text for e in old[r.doc_id].f or ())
        assert old[r.doc_id].f is None or r.n_chars == len(r.text)


def test_packing_round_trip(stages):
    from tokenizers import Tokenizer

    before, pieces = stages["packing"]
    library, sizes = Tokenizer.from_file(vocabulary_path()), {}
    for p in pieces.collect():
        sizes[p.doc_id] = sizes.get(p.doc_id, 0) + p.length
    assert sizes == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect()}


def tables(spark, folder, documents, labels, benchmark):
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, empties, repeated rows, a long text, and columns that operators use as names; each stage keeps the columns."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", 1), (1, "The quick brown fox jumps over the lazy dog near the river bank today", 1), (2, None, 2), (3, "", 3),
        (None, "write to ann@example.org now", 4), (4, "word " * 5000, 5), (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", 6), (6, "Mr. John Smith " * 3, None),
    ]
    documents = spark.createDataFrame(rows, "doc_id long, text string, node int").selectExpr("doc_id", "text", "node", "node AS label", "node AS rid", "node AS score", "node AS found", "node AS key", "cast(node as string) AS lang")
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    folder = tables(spark, tmp_path, documents, [(1, 1, 0), (4, 1, 0)], [(1, item), (2, None), (3, "")])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for n, (name, stage) in enumerate(C.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    left = {(r.doc_id, r.text) for r in docs.collect()}
    assert docs.count() == 6 and (2, None) in left and (3, "") in left and not any(i == 5 for i, _ in left)
    assert not any("ann@example.org" in (t or "") or "John Smith" in (t or "") for _, t in left)
    pieces = C.STAGES[-1][1](spark, docs, folder).collect()
    assert {p.doc_id for p in pieces} == {1, 2, 3, 4, 6, None}
    assert C.run(spark, folder).count() == len(pieces)


def test_stages_take_empty_tables(spark, tmp_path):
    folder = tables(spark, tmp_path, spark.createDataFrame([], "doc_id long, text string, lang string"), [], [])
    assert C.run(spark, folder).count() == 0
