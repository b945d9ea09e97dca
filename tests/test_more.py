import hashlib
import os
import shutil
import struct
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import config as C, schemas, storage
from millrace.functions import images as I
from millrace.operators import exact, people as P, similar as N, snapshot as V, views as W
from millrace.operators.ranked import placed
from millrace.operators.vectors import best_matches
from millrace.plans import folders
from millrace.sources import catalogue
from tests.test_catalogue import BASE, flip, frame, photo, sig, signed

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_rest_stands_without_the_optional_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 80 and not [n for n in q if n.startswith('op')] and 'pipeline' not in q and set(s) <= set(q); print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout) > 80
    (copy / "corpus_pipeline.py").unlink()
    subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, check=True)
    (copy / "millrace" / "llm").mkdir()
    (copy / "millrace" / "llm" / "registry.py").write_text("import no_such_module")
    failed = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
    assert failed.returncode and "no_such_module" in failed.stderr  # other failures are not swallowed


def test_workspaces_need_a_shared_folder_on_a_cluster_and_drop_their_tables(spark):
    class Cluster:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Cluster

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)
    ws = storage.Workspace(spark, "test")
    one, two = (ws.save(spark.range(3), n) for n in ("one", "two"))
    inner = storage.scratch(spark, "inner", ws)
    three = inner.save(spark.range(2), "three")
    ws.keep(two)
    there = lambda df: os.path.isdir(df._millrace_path.removeprefix("file:"))
    assert [there(x) for x in (one, two, three)] == [False, True, True]
    ws.close()
    assert not there(two) and not there(three)
    left = storage.Workspace(spark, "test").save(spark.range(1), "left")
    open_, storage._OPEN = storage._OPEN, {os.path.dirname(left._millrace_path)}
    storage.close_all(spark)
    assert not there(left) and not storage._OPEN
    storage._OPEN = open_


def test_tiers_read_no_more_than_they_must(spark, tmp_path, monkeypatch):
    head = 1000
    body = lambda first, last, n=5000: (first * head + b"x" * n)[: n - 1] + last
    files = {"a": body(b"1", b"a"), "b": body(b"1", b"a"), "c": body(b"1", b"c"), "d": body(b"2", b"d"), "e": b"alone", "f": body(b"3", b"f", 7000), "g": body(b"3", b"f", 7000)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = frame(spark, *[photo(k, name=n, size=len(data), docUri=f"file:{tmp_path / n}", sha=hashlib.sha256(data).hexdigest() if n in "fg" else None) for k, (n, data) in enumerate(files.items())])
    log = tmp_path / "reads"
    log.mkdir()
    read = catalogue.content_hash

    def counted(paths, limit=None):
        out = read(paths, limit)
        out.write.json(str(log / str(len(os.listdir(log)))))
        return out

    monkeypatch.setattr(catalogue, "content_hash", counted)
    got = {r.name: r.sha for r in catalogue.tiered_hashes(rows, head).collect()}
    assert got == {n: hashlib.sha256(files[n]).hexdigest() if n in "abcfg" else None for n in files}
    seen = spark.read.json([str(log / x) for x in os.listdir(log)])
    assert sorted((os.path.basename(r.path), r.bytes_read) for r in seen.collect()) == sorted([(n, head) for n in "abcd"] + [(n, 5000) for n in "abc"])
    assert exact.exact_groups(catalogue.tiered_hashes(rows, head)).select("n", "reclaimable").collect() == [(2, 7000), (2, 5000)]
    assert catalogue.tiered_hashes(rows.limit(0), head).count() == 0


def _brute_pairs(rows, level, cap=None):
    """Every pair that shares a byte (in a bucket of at most ``cap``) and has near hashes."""
    byte = lambda h, k: (h & (1 << 64) - 1) >> 8 * k & 255
    keys = {r[0]: {(s, k, byte(r[1 + s], k)) for s in (0, 1) for k in range(8)} for r in rows}
    sizes = {}
    for ks in keys.values():
        for k in ks:
            sizes[k] = sizes.get(k, 0) + 1
    out = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and any(cap is None or sizes[k] <= cap for k in keys[a[0]] & keys[b[0]]):
                dp, dd = (((a[k] ^ b[k]) & (1 << 64) - 1).bit_count() for k in (1, 2))
                if (dp <= level.p_max and dd <= level.d_max) or (dp <= level.p_strict and dd <= level.d_max + 6) or (dd <= level.d_strict and dp <= level.p_max + 4):
                    out.add((a[0], b[0], dp, dd))
    return out


@pytest.mark.parametrize("cap, block", [(None, 2048), (None, 4), (12, 2048), (12, 3), (1, 8)])
def test_near_hashes_lose_no_pair_of_a_large_bucket(spark, cap, block):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(120):
        near = lambda h: signed(h ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)))
        base = BASE if k % 3 else 0x1122334455667788
        rows.append((k, near(base), near(base)))
    items = spark.createDataFrame(rows, "id bigint, phash bigint, dhash bigint")
    for level in (C.STRICT, C.LOOSE):
        got = N.near_hashes(items, level, storage.Workspace(spark, "near"), cap, block).collect()
        assert len(got) == len({(r.a, r.b) for r in got}) and {tuple(r) for r in got} == _brute_pairs(rows, level, cap)
    assert N.near_hashes(items.limit(0), C.LOOSE, storage.Workspace(spark, "near"), cap, block).count() == 0


def test_places_by_range_sort(spark):
    rows = [(k % 3 if k < 90 else 7, k * 37 % 101, k) for k in range(100)]
    df = spark.createDataFrame(rows, "g int, x int, id int")
    got = {r.id: r.place for r in placed(df, "g", ["x", "id"], storage.Workspace(spark, "p")).collect()}
    assert got == {i: sorted((x, j) for h, x, j in rows if h == g).index((y, i)) for g, y, i in rows}
    assert placed(df.limit(0), "g", ["x"], storage.Workspace(spark, "p")).count() == 0


def test_group_order_and_places_follow_quality(spark):
    close = [photo(k, phash=flip(BASE, n), dhash=flip(BASE, n), colorSig=sig(3), size=2_000_000 - s) for k, n, s in ((1, 0, 0), (2, 1, 9000), (3, 1, 5000), (4, 2, 1000))]
    members = N.similar_groups(frame(spark, *close, photo(9, phash=signed(~BASE), dhash=signed(~BASE), colorSig=sig(9))))
    assert [(r.place, r.id, r.distance) for r in N.places(members).orderBy("place").collect()] == [(0, 1, 0), (1, 3, 1), (2, 2, 1), (3, 4, 2)]
    (group,) = N.group_order(members).collect()
    assert (group.keeper_id, group.n, group.reclaimable, group.worst) == (1, 4, 3 * 2_000_000 - 15000, 2)
    (preview,) = W.previews(N.places(members), 2).collect()
    assert (preview.first, preview.overflow) == ([3, 2], 1)
    moved = N.with_keeper(members, 1, 3).collect()
    assert {r.id: (r.is_keeper, r.distance) for r in moved}[1] == (False, None) and [r.id for r in moved if r.is_keeper] == [3]


def test_best_matches_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 8)).round(1)
    v[40:50] = v[3]  # ties
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(90, None), (91, [1.0])], "id bigint, v array<double>")
    got = {}
    for r in best_matches(df.where("id % 5 = 0"), df, 4, "id", "id", "v", others=True, digits=6, block=16).collect():
        got.setdefault(r.query, {})[r.place] = (r.item, round(r.cosine, 6))
    for q in range(0, 90, 5):
        scores = sorted((-round(float(v[q] @ v[k]), 6), k) for k in range(90) if k != q)[:4]
        assert [got[q][p] for p in range(4)] == [(k, -s) for s, k in scores], q
    assert 90 not in got and best_matches(df.limit(0), df, 1, "id", "id", "v").count() == 0


def test_writes_and_faces(spark):
    v = [1.0] * 4
    faces = spark.createDataFrame([(k, k // 2, 0, 0, 10, 10, 0.5, v, 1, k % 2, k % 3, k == 0) for k in range(8)], schemas.FACES)
    scans = spark.createDataFrame([(k, 1, 2, 1) for k in range(4)], schemas.FACE_SCAN)
    detected = spark.createDataFrame([(p, x, 0, 10, 10, 0.9, v, 1) for p in (1, 2) for x in (5, 3)], "photoId bigint, l int, t int, r int, b int, quality float, embedding array<float>, embVersion int")
    checks = spark.createDataFrame([(1, 9, 2, 1), (2, 9, 2, 1), (3, 9, 0, 1)], schemas.FACE_SCAN)
    after, seen = V.replace_faces(faces, scans, detected, checks)
    assert sorted((r.faceId, r.photoId, r.l) for r in after.collect()) == [(0, 0, 0), (1, 0, 0), (8, 1, 3), (9, 1, 5), (10, 2, 3), (11, 2, 5)]
    assert sorted((r.photoId, r.dateModified) for r in seen.collect()) == [(0, 1), (1, 9), (2, 9), (3, 9)]
    put = V.write_clusters(faces, spark.createDataFrame([(0, 5, 6)], "faceId bigint, clusterId int, personId bigint"))
    assert put.schema == faces.schema and [(r.clusterId, r.personId, r.pinned) for r in put.where("faceId = 0").collect()] == [(5, 6, True)]
    people = spark.createDataFrame([(1, "A")], schemas.PEOPLE)
    nobody = faces.withColumn("personId", F.lit(0).cast("bigint"))
    stamped, more, person = P.ensure_person(nobody, people, 1)
    assert person == 2 and more.count() == 2 and stamped.where("clusterId = 1 and personId = 2").count() == 4
    assert P.ensure_person(faces, people, 0)[2] in (1, 2) and P.next_cluster(faces.limit(0)) == 0
    covers = lambda *photos: [r.coverPath for r in P.with_covers(P.people_view(faces, people), faces, frame(spark, *photos)).collect()]
    assert covers(photo(0)) == ["/x/p0"] * 2 and covers(photo(9)) == [None] * 2
    assert V.migrate(spark.createDataFrame([("1", 2)], "id string, odd int"), schemas.PEOPLE + ", id bigint").collect() == [(None, None, 1)]


def test_plans_take_the_right_sanitiser(spark):
    rows = frame(spark, photo(1), photo(2, docUri="u"))
    assert {(r.action, r.target) for r in folders.move_plan(rows, " a.b/c ").collect()} == {("relocate", "Pictures/abc/"), ("copy_then_delete", "Pictures/abc/")}
    plan = folders.month_members(rows).withColumn("name", F.lit("x.y/z")).withColumn("enabled", F.lit(True))
    assert {(r.action, r.target) for r in folders.organise_plan(folders.chosen(plan).select("photoId", F.col("name").alias("suggestedName")), rows).collect()} == {("relocate", "Pictures/x.yz/"), ("unsupported", "Pictures/x.yz/")}
    key = plan.first().key
    assert folders.chosen_count(folders.with_choice(plan, key, enabled=False)).collect() == [(0, 0)] and folders.chosen_count(folders.with_choice(plan, key, name=" ")).first().photos == 0


def jpeg(spark, path, rgb, orientation=None):
    """Write a picture through the JVM, with an orientation tag."""
    jvm = spark.sparkContext._jvm
    h, w, _ = rgb.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            r, g, b = (int(c) for c in rgb[y, x])
            image.setRGB(x, y, r << 16 | g << 8 | b)
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))
    if orientation:
        data = path.read_bytes()
        tiff = b"II*\0" + struct.pack("<IHHHIHHI", 8, 1, 0x0112, 3, 1, orientation, 0, 0)
        body = b"Exif\0\0" + tiff
        path.write_bytes(data[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + data[2:])


def test_pictures_are_turned_and_subsampled_before_they_are_hashed(spark, tmp_path):
    plain = I.resize(np.random.default_rng(5).integers(0, 256, (9, 12, 3)), 48, 64).astype(int)  # smooth, of many frequencies
    stored = np.rot90(plain, 1)  # a reader has to turn it clockwise by 90 degrees
    jpeg(spark, tmp_path / "a.jpg", np.kron(plain, np.ones((4, 4, 1))))
    jpeg(spark, tmp_path / "b.jpg", np.kron(stored, np.ones((4, 4, 1))), 6)
    assert [I.orientation_degrees((tmp_path / n).read_bytes()) for n in ("a.jpg", "b.jpg")] == [0, 90]
    decoded = catalogue.orientations(catalogue.read_images(spark, str(tmp_path)))
    a, b = catalogue.signatures(decoded).orderBy("origin").collect()
    near = lambda p, q: ((p ^ q) & (1 << 64) - 1).bit_count()
    assert near(a.dhash, b.dhash) <= 6 and near(a.phash, b.phash) <= 6 and max(abs(p - q) for p, q in zip(a.colorSig, b.colorSig, strict=True)) <= 6
    turned = catalogue.signatures(decoded.drop("degrees")).orderBy("origin").collect()[1]
    assert near(a.phash, turned.phash) > 6
    broken = decoded.withColumn("data", F.lit(bytearray(b"xx"))).limit(1)
    assert catalogue.signatures(broken).first().phash is None
    assert I.subsampled(np.zeros((400, 801, 3)), 96).shape == (100, 200, 3) and I.sample_size(400, 801, 96) == 4 and I.sample_size(200, 2000, 180, 1280) == 2


def test_faces_are_gated_aligned_and_embedded(spark, tmp_path):
    y, x = np.mgrid[0:160, 0:200]
    jpeg(spark, tmp_path / "f.jpg", np.stack([x, y, x // 2 + y // 2], -1) % 256)
    decoded = catalogue.read_images(spark, str(tmp_path))
    origin = decoded.first().origin
    rows = [(origin, 40, 30, 140, 130, 5.0, 3.0, 70.0, 70.0, 110.0, 70.0), (origin, 0, 0, 30, 30, 0.0, 0.0, None, None, None, None), (origin, 40, 30, 140, 130, 50.0, 0.0, None, None, None, None)]
    found = spark.createDataFrame(rows, "origin string, l int, t int, r int, b int, yaw double, roll double, lx double, ly double, rx double, ry double")
    (face,) = catalogue.face_rows(decoded, found).collect()
    assert len(face.embedding) == 1568 and abs(np.linalg.norm(face.embedding) - 1) < 1e-5 and 0 < face.quality <= 1 and face.l < face.r <= 10000


def test_models_are_tried_in_order(tmp_path):
    small, good, wide, bad = (tmp_path / n for n in ("small", "good", "wide", "bad"))
    small.write_bytes(b"x")
    for f in (good, wide, bad):
        f.write_bytes(b"x" * 2000)

    def load(path):
        if path == str(bad):
            raise RuntimeError("no model")
        dim = 4096 if path == str(wide) else 192
        return lambda rgb: np.ones(dim), dim, 112

    assert [I.model_fault(str(p), load) for p in (small, tmp_path / "none", bad, wide, good)] == ["too small", "too small", "can't be loaded: RuntimeError", "output of 4096 values", None]
    assert I.choose_embedder(str(bad), str(good), load=load) == str(good) and I.EMBEDDERS[str(good)][1:] == (192, C.model_version(2000, 192))
    assert I.choose_embedder(None, str(wide), load=load) == "hog"
    assert I.model_fault(str(good)) is not None  # not an ONNX file
    assert [I.input_mode(*x) for x in ((True, 160), (False, 160), (False, 112))] == ["raw", "standard", "fixed"]
    rgb = np.arange(12).reshape(2, 2, 3)
    assert I.normalise_pixels(rgb, "raw").dtype == np.uint8 and I.normalise_pixels(rgb, "fixed")[0, 0, 0] == np.float32(-127.5 / 128)
    assert abs(I.normalise_pixels(rgb, "standard").mean()) < 1e-6 and I.normalise_pixels(np.full((2, 2, 3), 7), "standard").max() == 0
    assert I.dequantised(np.array([0, 128, 255], np.uint8), 128, 0.5).tolist() == [-64.0, 0.0, 63.5]
    assert I.thumbnail_box(1000, 2000, 1100, 5000) == (0.1, 0.2, 0.02, 0.3)
    with pytest.raises(ValueError):
        I.register_embedder("odd", lambda rgb: np.ones(3), 3, 1)


def test_settings():
    p = C.Prefs()
    assert p.update(similarity="loose", scan_roots=["/a"]) == C.Prefs(similarity="loose", scan_roots=("/a",))
    assert p.update(similarity="loose").update(similarity="odd") == C.Prefs(similarity="loose")


def test_activity_of_a_stream(spark, tmp_path):
    from millrace.streaming.incremental import activity

    rows = [(f"2026-01-01 10:{m:02d}:00", kind) for m, kind in ((1, "a"), (5, "a"), (50, "b"))] + [("2026-01-01 12:00:00", "a")]
    spark.createDataFrame(rows, "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    activity(stream).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.event_type, r.n) for r in spark.table("activity").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_nearest_centroids_sent_or_met_in_blocks(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 6))
    centres[7] = centres[2]
    rows = [(k, v.tolist()) for k, v in enumerate(np.vstack([rng.normal(size=(30, 6)), centres[[2]]]))] + [(90, [1.0]), (91, None)]
    df = spark.createDataFrame(rows, "faceId bigint, embedding array<double>")
    one, two = ({r.faceId: (r.near, round(r.cosine, 9)) for r in P.nearest(df, centres, sent_bytes=n).collect()} for n in (1 << 20, 0))
    assert one == two and one[30][0] == 7 and one[90] == one[91] == (-1, -1.0)
