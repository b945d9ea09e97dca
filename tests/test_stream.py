"""The stored catalogue under a stream: only what a batch names is read and written."""

import os

from millrace import schemas
from millrace.operators.snapshot import merge_snapshot
from millrace.streaming.incremental import Catalogue, follow
from tests.test_catalogue import frame, photo


def rows(df):
    return sorted((r.id, r.size, r.bucket, r.sha, r.sigVersion) for r in df.collect())


def files(store):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(store.path) for f in names if f.endswith(".parquet")}


def test_three_batches_and_a_replay_touch_their_buckets_only(spark, tmp_path):
    store = Catalogue(spark, str(tmp_path / "store"), schemas.PHOTOS, buckets=16)
    bucket = {r.id: r.b for r in spark.range(60).selectExpr("id", "cast(pmod(xxhash64(id), 16) as int) b").collect()}
    batches = [frame(spark, *[photo(k) for k in range(40)]), frame(spark, photo(3, size=7), photo(5, bucket="New"), photo(50)), frame(spark, photo(50, size=9))]
    source, want = tmp_path / "in", None
    for batch in batches:
        before, kept = files(store), store.state(store.versions())
        batch.coalesce(1).write.mode("append").parquet(str(source))
        follow(spark.readStream.schema(schemas.PHOTOS).parquet(str(source)), store, str(tmp_path / "cp")).awaitTermination()
        named = {bucket[r.id] for r in batch.collect()}
        versions = store.versions()
        assert versions[max(versions)] == named
        new = {f for f in files(store) if f not in before}
        assert {f.split("part=")[1].split("/")[0] for f in new} == {str(b) for b in named}
        assert {b: v for b, v in store.state(versions).items() if b not in named} == {b: v for b, v in kept.items() if b not in named}
        want = spark.createDataFrame(merge_snapshot(want or frame(spark), batch).drop("outcome").collect(), schemas.PHOTOS)
        assert rows(store.read()) == rows(want)
    store.upsert(batches[2])  # the last batch again
    store.upsert(batches[2])
    assert rows(store.read()) == rows(want) and len(rows(want)) == 41
    held = sum(len(b) for b in store.versions().values())
    assert held <= 2 * 16 and all(os.path.isdir(f"{store.path}/v{v}/part={b}") for b, v in store.state(store.versions()).items())


def test_a_write_that_was_cut_short_is_not_read(spark, tmp_path):
    store = Catalogue(spark, str(tmp_path / "store"), schemas.PHOTOS, buckets=4)
    assert store.read().count() == 0
    store.upsert(frame(spark, photo(1), photo(2)))
    store.upsert(frame(spark, photo(2, size=5)))
    os.remove(f"{store.path}/v2/_SUCCESS")
    assert {r.id: r.size for r in store.read().collect()} == {1: 2_000_000, 2: 2_000_000}
    store.upsert(frame(spark, photo(2, size=6)))
    assert {r.id: r.size for r in store.read().collect()} == {1: 2_000_000, 2: 6} and max(store.versions()) == 3
    store.upsert(frame(spark))
    assert max(store.versions()) == 3


def test_hashes_survive_a_touch_and_go_with_a_change(spark, tmp_path):
    store = Catalogue(spark, str(tmp_path / "store"), schemas.PHOTOS, buckets=3)
    store.upsert(frame(spark, *[photo(k) for k in range(6)]))
    assert {(r.sha, r.sigVersion) for r in store.read().collect()} == {(None, 0)}
    store.put(frame(spark, *[photo(k, sha=f"h{k}") for k in (1, 2, 4)]))
    store.upsert(frame(spark, photo(1, bucket="Moved"), photo(2, size=1)))
    assert {r.id: (r.bucket, r.size, r.sha, r.sigVersion) for r in store.read().collect()} == {
        0: ("DCIM", 2_000_000, None, 0), 1: ("Moved", 2_000_000, "h1", 1), 2: ("DCIM", 1, None, 0), 3: ("DCIM", 2_000_000, None, 0), 4: ("DCIM", 2_000_000, "h4", 1), 5: ("DCIM", 2_000_000, None, 0),
    }
