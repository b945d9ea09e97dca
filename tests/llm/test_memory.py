"""What tasks hold while they work, and what workers and executors hold afterwards."""

import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from millrace.llm import jaccard_join as J, packing as P, quality_classifier as Q
from millrace.llm.text import encoded, slices


def _texts(n=700, words=1000, seed=3):
    rng = random.Random(seed)
    known = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(3000)]
    return [" ".join(rng.choices(known, k=words)) for _ in range(n)]


def _peak(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / (1 << 20)
    finally:
        tracemalloc.stop()


def test_a_batch_of_texts_takes_little_memory():
    batch = pa.RecordBatch.from_arrays([pa.array(_texts())], names=["text"])
    assert batch.nbytes > 4 << 20
    vectors = np.random.default_rng(1).normal(size=(Q.BUCKETS, Q.DIM)).astype(np.float32)
    pool = lambda limit: np.concatenate([Q.pooled(encoded(part.column(0)), vectors) for part in slices(batch, 0, limit)])
    by_slices, peak = _peak(lambda: pool(Q.SLICE))
    assert peak < 25
    assert np.array_equal(by_slices, pool(1 << 30))
    n, peak = _peak(lambda: sum(len(s) for _, s in J._new_sets(batch, 5, set(), frozenset())))
    assert n > 600_000 and peak < 25


def test_filters_leave_the_executors_once_pairs_are_compared(spark, monkeypatch):
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(broadcast(self, value)) or sent[-1])
    texts = _texts(20, 60)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts + [t + " end" for t in texts])], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs).collect()}
    assert got == {k: k % 20 for k in range(40)}
    assert len(sent) >= 2 and not any(os.path.exists(b._path) for b in sent)


def test_no_vocabulary_stays_in_a_reused_worker(spark):
    docs = spark.createDataFrame([(k, f"some words {k} and Слово") for k in range(200)], "doc_id bigint, text string").repartition(8)
    assert P.pack(docs).select("doc_id").distinct().count() == 200

    def held(batches):
        from millrace.llm import packing

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([packing._words.cache_info().currsize] * len(b), pa.int32())], names=["n"])

    assert {r.n for r in spark.range(64, numPartitions=8).mapInArrow(held, "n int").collect()} == {0}
