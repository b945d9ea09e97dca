import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from millrace import config as C, schemas
from millrace.functions import images as I, scalar as S
from millrace.operators import exact, people as P, similar as N, snapshot as V
from millrace.operators.components import connected_components
from millrace.plans import folders


def sig(seed):
    return [(i * 37 + seed * 11) % 200 + 20 for i in range(48)]


def signed(v):
    v &= (1 << 64) - 1
    return v - (1 << 64) if v >> 63 else v


def flip(v, n):
    for k in range(n):
        v ^= 1 << (k * 3 % 64)
    return signed(v)


def photo(id, **kw):
    row = dict(id=id, name=f"p{id}", bucket="DCIM", relPath=f"/x/p{id}", size=2_000_000, width=4000, height=3000, dateAdded=1_700_000_000, dateModified=1_700_000_000, dateTaken=0, mime="image/jpeg", sha=None, dhash=0, phash=0, colorSig=sig(1), sigVersion=1, docUri=None)
    return tuple((row | kw).values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.PHOTOS)


def test_exact_groups_and_keepers(spark):
    df = frame(spark, *[photo(k, sha=s) for k, s in enumerate(["A", "A", "A", "B", None], 1)])
    (g,) = exact.exact_groups(df).collect()
    assert (g.n, g.reclaimable) == (3, 4_000_000)
    two = frame(spark, photo(1, width=1000, height=750, size=200_000, dateModified=100, sha="S"), photo(2, dateModified=500, sha="S"))
    assert [exact.exact_groups(two, r).first().keeper_id for r in C.KeeperRule] == [2, 1, 2]
    assert [r.place for r in exact.exact_members(df).orderBy("place").collect()] == [0, 1, 2]
    assert exact.exact_groups(df.limit(0)).count() == 0


BASE = 0x0F1E2D3C4B5A6978


def test_similar_groups_scenarios(spark):
    g3 = frame(spark, photo(1, phash=BASE, dhash=BASE, colorSig=sig(3)), photo(2, phash=flip(BASE, 2), dhash=flip(BASE, 3), colorSig=sig(3), size=300_000), photo(3, phash=signed(~BASE), dhash=signed(~BASE), colorSig=sig(9)))
    assert {r.id for r in N.similar_groups(g3).collect()} == {1, 2}
    h = 0x1122334455667788
    colour = frame(spark, photo(1, phash=h, dhash=h, colorSig=sig(2)), photo(2, phash=h, dhash=h, colorSig=sig(40)))
    assert N.similar_pairs(colour).count() == 0 and N.similar_pairs(colour, C.LOOSE).first().dc == 30
    aspect = frame(spark, photo(1, phash=h, dhash=h, width=2000, height=2000), photo(2, phash=h, dhash=h, width=3840, height=1080))
    assert N.similar_pairs(aspect).count() == 0
    flat = frame(spark, photo(1, colorSig=[128] * 48), photo(2, colorSig=[128] * 48))
    assert N.similar_pairs(flat).count() == 0 and N.flat(flat).count() == 2
    same = frame(spark, photo(1, sha="Z", phash=7, dhash=7, colorSig=sig(5)), photo(2, sha="Z", phash=7, dhash=7, colorSig=sig(5)))
    assert N.similar_groups(same).count() == 0


def brute_force_refine(pool, score, similar, rounds=C.REFINE_ROUNDS):
    """Plain statement of ``refine``; ``similar``: every similar pair ``a < b``, not only candidates."""
    if len(pool) <= 2:
        return [set(pool)]
    out, left = [], sorted(pool)
    for _ in range(rounds):
        if not left:
            break
        anchor = max(left, key=lambda k: (score[k], -k))
        keep = {k for k in left if k == anchor or (min(k, anchor), max(k, anchor)) in similar}
        out.append(keep)
        left = [k for k in left if k not in keep]
    return [*out, set(left)] if left else out


def test_levels_are_monotonic_and_refine_matches_brute_force(spark):
    rows = frame(spark, *[photo(i + 1, phash=flip(BASE, 2 * i), dhash=flip(BASE, 2 * i), colorSig=sig(3), size=2_000_000 + 2000 * i) for i in range(6)])
    strict, loose = N.similar_groups(rows, C.STRICT), N.similar_groups(rows, C.LOOSE)
    assert loose.count() >= strict.count()
    edges = {(r.a, r.b) for r in N.similar_pairs(rows, C.STRICT).collect()}
    score = {r.id: r.s for r in rows.select("id", S.quality_score(F.col("width"), F.col("height"), F.col("size")).alias("s")).collect()}
    comps = {}
    for r in N.similar_components(rows, C.STRICT).collect():
        comps.setdefault(r.component, []).append(r.id)
    want = {frozenset(s) for pool in comps.values() for s in brute_force_refine(pool, score, edges) if len(s) > 1}
    got = {}
    for r in strict.collect():
        got.setdefault(r.set_id, set()).add(r.id)
    assert {frozenset(s) for s in got.values()} == want


def test_refine_compares_members_with_the_anchor_not_with_candidates(spark):
    ones = lambda *ks: sum(1 << 8 * k for k in ks)  # noqa: E731  one bit in each of these bytes
    half, whole = signed(BASE ^ ones(0, 1, 2, 3)), signed(BASE ^ ones(*range(8)))
    rows = frame(spark, *[photo(k, phash=h, dhash=h, size=2_000_000 - 2000 * k) for k, h in enumerate((BASE, half, whole), 1)])
    assert {(r.a, r.b) for r in N.similar_pairs(rows, C.LOOSE).collect()} == {(1, 2), (2, 3)}  # 1 and 3 share no byte
    assert {(r.set_id, r.id) for r in N.similar_groups(rows, C.LOOSE).collect()} == {(1, 1), (1, 2), (1, 3)}
    # what a round leaves over is compared as well, also when it is two
    star = frame(spark, *[photo(k, phash=signed(BASE ^ x), dhash=signed(BASE ^ x), size=2_000_000 - 2000 * k) for k, x in enumerate((0xF, 0, 0xF00, 0xF0000), 1)])
    assert {r.id for r in N.similar_components(star, C.STRICT).collect()} == {1, 2, 3, 4}
    assert {(r.set_id, r.id) for r in N.similar_groups(star, C.STRICT).collect()} == {(1, 1), (1, 2)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
def test_components_match_union_find(spark, pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()}
    assert got == {k: root(k) for k in parent}


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first().x
    arr = lambda v: F.array(*[F.lit(x) for x in v])
    assert [val(S.color_distance(arr(sig(a)), arr(sig(b)))) for a, b in ((2, 40), (3, 9), (3, 3))] == [30, 88, 0]
    assert [val(S.color_spread(arr(sig(k)))) for k in (1, 2, 3)] == [194, 193, 193]
    assert val(S.hamming(F.lit(-1).cast("bigint"), F.lit(5).cast("bigint"))) == 62
    assert [val(S.human_bytes(F.lit(n).cast("bigint"))) for n in (0, 1023, 1024, 1536)] == ["0 B", "1023 B", "1.0 KB", "1.5 KB"]
    assert val(S.similarity_words(F.lit(2))) != val(S.similarity_words(F.lit(3))) == val(S.similarity_words(F.lit(6)))
    assert val(S.extension(F.lit("a.b.JPG"))) == "jpg" and val(S.extension(F.lit("none"))) == ""
    assert val(S.tree_path(F.lit("primary:A/B/"))) == "/storage/emulated/0/A/B" and val(S.tree_path(F.lit("12-3:"))) == "/storage/12-3"
    assert I.synthetic_id("a") == 4611717133418753164
    assert C.model_version(5_233_396, 192) == 735588 and C.scan_version(735588, "high") == 743507


def test_image_hashes_against_direct_sums():
    rng = np.random.default_rng(3)
    plane = rng.uniform(0, 255, (32, 32))
    low = [[sum(plane[y, x] * np.cos(np.pi / 32 * (y + 0.5) * u) * np.cos(np.pi / 32 * (x + 0.5) * v) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
    rest = sorted(np.ravel(low)[1:])
    want = sum(1 << k for k, x in enumerate(np.ravel(low)) if k and x > (rest[30] + rest[31]) / 2)
    assert I.phash(plane) & (1 << 64) - 1 == want
    assert I.dhash(np.tile(np.arange(9)[::-1], (8, 1))) == -1
    assert len(I.hog(rng.uniform(0, 255, (80, 70, 3)))) == I.EMBEDDERS["hog"][1] == 1568
    m = I.eye_transform((30, 40), (60, 50))
    assert np.allclose(m @ [30, 40, 1], I.LEFT_EYE, atol=0.2) and np.allclose(m @ [60, 50, 1], I.RIGHT_EYE, atol=0.2)
    assert I.orientation_degrees(b"junk") == 0


def jitter(rng, base, s):
    v = base + rng.uniform(-0.5, 0.5, len(base)) * s
    return (v / np.linalg.norm(v)).tolist()


def faces(spark, rows):
    full = [(i, i, 0, 0, 100, 100, float(q), [float(x) for x in v], 1, c, p, pin) for i, q, v, c, p, pin in rows]
    return spark.createDataFrame(full, schemas.FACES)


def test_clusters_pins_names(spark):
    rng = np.random.default_rng(7)
    ids = [v / np.linalg.norm(v) for v in rng.uniform(-0.5, 0.5, (6, 192))]
    rows = [(8 * k + j, 0.8, jitter(rng, b, 0.12), -1, 42 if k == 0 else 0, False) for k, b in enumerate(ids) for j in range(8)]
    out = P.cluster(faces(spark, [*rows, (99, 0.05, ids[0], -1, 0, False), (100, 0.02, ids[1], 7, 77, True)]), 0.62).collect()
    got = {r.faceId: r for r in out}
    assert len({got[k].clusterId for k in range(48)}) == 6 and all(len({got[8 * k + j].clusterId for j in range(8)}) == 1 for k in range(6))
    assert got[99].clusterId == -1 and (got[100].clusterId, got[100].personId) == (7, 77) and all(got[j].personId == 42 for j in range(8))
    b = [(k, 0.8, jitter(rng, ids[1], 0.1), 0, 77, False) for k in range(10, 15)]
    a = [(k, 0.8, jitter(rng, ids[0], 0.1), -1, 0, False) for k in range(1, 6)]
    got = {r.faceId: r for r in P.cluster(faces(spark, [*a, *b, (99, 0.8, jitter(rng, ids[0], 0.1), -1, 77, True)]), 0.62).collect()}
    assert got[99].clusterId == got[10].clusterId and got[99].personId == 77
    assert P.cluster(faces(spark, rows).limit(0), 0.62).count() == 0


def test_faces_beyond_the_first_seeds_found_clusters(spark):
    rng = np.random.default_rng(9)
    ids = [v / np.linalg.norm(v) for v in rng.uniform(-0.5, 0.5, (6, 192))]
    rows = faces(spark, [(8 * k + j, 0.9 - 0.05 * k, jitter(rng, b, 0.12), -1, k + 1, False) for k, b in enumerate(ids) for j in range(8)])
    for seeds in (200_000, 48, 10, 8, 3):
        got = {r.faceId: r for r in P.cluster(rows, 0.62, seeds).collect()}
        assert [[got[8 * k + j].clusterId for j in range(8)] for k in range(6)] == [[k] * 8 for k in range(6)], seeds
        assert all(got[8 * k + j].personId == k + 1 for k in range(6) for j in range(8))


def test_snapshot_merge(spark):
    old = frame(spark, photo(1, sha="A"), photo(2, sha="B"), photo(3, sha="C"))
    new = frame(spark, photo(1, bucket="New"), photo(2, size=5), photo(4))
    rows = {r.id: r for r in V.merge_snapshot(old, new).collect()}
    assert {k: r.outcome for k, r in rows.items()} == {1: "touched", 2: "changed", 3: "gone", 4: "new"}
    assert (rows[1].sha, rows[1].bucket, rows[2].sha, rows[2].sigVersion) == ("A", "New", None, 0)
    assert [r.id for r in V.gone_ids(old, new).collect()] == [3]
    again = V.merge_snapshot(old, old)
    assert {r.outcome for r in again.collect()} == {"touched"}


def test_plans(spark):
    import datetime as dt

    ms = lambda *a: int(dt.datetime(*a, 12, tzinfo=dt.UTC).timestamp() * 1000)
    months = folders.by_months(frame(spark, photo(1, dateTaken=ms(2026, 8, 3)), photo(2, dateTaken=ms(2026, 8, 20)), photo(3, dateTaken=ms(2025, 12, 1)), photo(4, dateTaken=0, dateModified=ms(2026, 3, 9) // 1000))).collect()
    assert [(r.suggestedName, r.n) for r in months] == [("2026-08 Avqust", 2), ("2026-03 Mart", 1), ("2025-12 Dekabr", 1)] and months[0].key == "month-202607"
    members = spark.createDataFrame([(1, 1, "Anar", p) for p in (1, 2, 3, 7)] + [(2, 2, None, p) for p in (7, 8)], "clusterId int, personId bigint, name string, photoId bigint")
    plan = folders.by_people(members).collect()
    assert {r.photoId for r in plan} == {1, 2, 3, 7} and {r.suggestedName for r in plan} == {"Anar"}
    assert folders.by_people(members.where("photoId = 8")).count() == 0
    assert {r.action for r in folders.removal_plan(frame(spark, photo(1), photo(2, docUri="u"))).collect()} == {"trash", "delete_document"}


def test_folder_walk_images_and_stream(spark, tmp_path):
    import struct
    import zlib

    from millrace.sources import catalogue
    from millrace.streaming.incremental import Catalogue, follow

    def png(path, rgb):
        h, w, _ = rgb.shape
        raw = b"".join(b"\0" + r.astype(np.uint8).tobytes() for r in rgb)
        chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    root = tmp_path / "pics"
    (root / "a").mkdir(parents=True)
    (root / ".hid").mkdir()
    img = np.random.default_rng(1).integers(0, 255, (40, 50, 3))
    png(root / "a" / "x.png", img)
    png(root / ".hid" / "y.png", img)
    (root / "note.txt").write_text("no image")
    found = catalogue.walk(spark, str(root)).collect()
    assert [(r.name, r.bucket) for r in found] == [("x.png", "a")]
    (s,) = catalogue.signatures(catalogue.read_images(spark, str(root / "a"))).collect()
    assert (s.dhash, s.phash, s.colorSig) == I.signature(img)
    gone = "file:" + str(root / "gone.png")
    hashes = {r.path: r for r in catalogue.content_hash(spark.createDataFrame([(found[0].docUri,), (gone,)], "path string"), 100).collect()}
    assert hashes[found[0].docUri].bytes_read == 100 and hashes[gone].hash is None
    assert catalogue.walk_roots(spark, [str(tmp_path / "no folder"), str(root)], frame(spark)).count() == 1 and catalogue.walk(spark, str(root), max_files=1).count() == 1
    store = Catalogue(spark, str(tmp_path / "store"), schemas.PHOTOS)
    incoming = tmp_path / "in"
    frame(spark, photo(1, sha="A"), photo(2)).write.parquet(str(incoming))
    follow(spark.readStream.schema(schemas.PHOTOS).parquet(str(incoming)), store, str(tmp_path / "cp")).awaitTermination()
    assert {r.id for r in store.read().collect()} == {1, 2}


@pytest.mark.parametrize("stored, want", [({}, C.Prefs()), ({"similarity": "odd", "use_trash": False}, C.Prefs(use_trash=False))])
def test_prefs(stored, want):
    assert C.Prefs.read(stored) == want
