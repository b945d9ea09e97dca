import corpus_pipeline
import pytest


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    first = docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == first.columns
        docs = spark.createDataFrame(docs.collect(), first.schema)
        counts.append(docs.count())
    assert first.count() >= counts[0] >= counts[1] == counts[2] > 0
    assert corpus_pipeline.packing(spark, docs, sf).count() >= 1
    assert corpus_pipeline.near_copies(spark, first.limit(0), sf).count() == 0


def test_near_copies_of_repeated_ids_with_different_texts(spark):
    text = lambda x: " ".join(f"{x}{k}" for k in range(60))
    rows = [(1, text("a")), (2, text("a") + " end"), (2, text("b")), (3, text("c")), (3, text("d")), (3, text("d")), (10, text("e")), (9, text("e")), (-4, text("f")), (4, text("f")), (None, text("g"))]
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    want = [rows[k] for k in (0, 2, 3, 4, 7, 8, 10)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
