"""The face table function: gates, transforms, crops."""

import math

import numpy as np
import pyarrow as pa
import pytest

from millrace.functions import images as I
from millrace.sources import faces

SCHEMA = f"origin string, width int, height int, nChannels int, data binary, detections {faces.DETECTIONS}, face int, quality string"
EYES = (40, 30, 140, 130, 5.0, 3.0, 70.0, 70.0, 110.0, 72.0)
BOX = (-10, -10, 60, 70, 10.0, 20.0, None, None, None, None)
SMALL, TURNED, TILTED, ONE_EYE = (0, 0, 39, 90, 0.0, 0.0, *[None] * 4), (0, 0, 90, 90, 46.0, 0.0, *[None] * 4), (0, 0, 90, 90, 0.0, 31.0, *[None] * 4), (0, 0, 90, 90, 0.0, 10.0, 20.0, 20.0, None, None)


def picture(channels=3):
    return np.random.default_rng(channels).integers(0, 256, (160, 200, channels)).astype(np.uint8)


def crop(rgb, transform, size=I.TEMPLATE):
    """Plain: a pixel of the crop at a time, black outside."""
    (a, b, tx), (c, d, ty) = transform
    det, out = a * d - b * c, np.zeros((size, size, 3))
    at = lambda y, x: rgb[y, x].astype(float) if 0 <= y < rgb.shape[0] and 0 <= x < rgb.shape[1] else np.zeros(3)
    for y in range(size):
        for x in range(size):
            sx, sy = (d * (x - tx) - b * (y - ty)) / det, (a * (y - ty) - c * (x - tx)) / det
            x0, y0 = math.floor(sx), math.floor(sy)
            fx, fy = sx - x0, sy - y0
            out[y, x] = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return out


def test_one_photo_to_many_faces(spark):
    rgb = picture()
    data = rgb[..., ::-1].tobytes()
    rows = [
        ("a", 200, 160, 3, data, [SMALL, EYES, TURNED, BOX, TILTED, ONE_EYE, EYES]), ("b", 200, 160, 3, b"short", [EYES]), ("c", 200, 160, 3, None, [BOX]), ("d", 200, 160, 3, data, None),
        ("e", 200, 160, 3, data, []), ("f", None, None, None, None, [EYES]), (None, 200, 160, 1, picture(1).tobytes(), [BOX]), ("a", 200, 160, 3, data, [BOX]), ("g", 200, 160, 3, data, [None, BOX]),
    ]
    photos = spark.createDataFrame([(*r, 9, "clash") for r in rows], SCHEMA)
    got = sorted(faces.photo_faces(photos).collect(), key=lambda r: (r.origin or "", r.face, len(r.embedding or ())))
    assert [(r.origin, r.face) for r in got] == [(None, 0), ("a", 0), ("a", 1), ("a", 3), ("a", 5), ("a", 6), ("b", 0), ("c", 0), ("g", 1)]
    assert [r.embedding is None for r in got] == [r.origin in ("b", "c") for r in got] and all((r.embVersion is None) == (r.embedding is None) for r in got)
    eyes, box = I.eye_transform((70, 70), (110, 72)), I.box_transform(0, 0, 60, 70)
    for r, m in ((got[2], eyes), (got[5], eyes), (got[3], box), (got[1], box)):
        assert r.transform == pytest.approx(m.ravel().tolist()) and r.embedding == pytest.approx(I.hog(crop(rgb, m)), abs=1e-5)
    assert (got[3].l, got[3].t, got[3].r, got[3].b) == (0, 0, 4400, 5500) and got[4].transform == pytest.approx(I.box_transform(0, 0, 90, 90).ravel().tolist())
    assert faces.photo_faces(photos.limit(0)).count() == 0


def test_the_table_function_in_sql(spark):
    photos = spark.createDataFrame([("a", 200, 160, 3, picture().tobytes(), [EYES, BOX, SMALL], 1, "x")], SCHEMA)
    photos.withColumn("found", faces.gated_faces(photos.detections, photos.width, photos.height)).createOrReplaceTempView("taken")
    faces.register(spark)
    got = spark.sql("select origin, f.face, size(f.embedding) as dim from taken, lateral align_faces(width, height, nChannels, data, found) f where f.quality > 0.1 order by f.face").collect()
    assert [tuple(r) for r in got] == [("a", 0, 1568), ("a", 1, 1568)]
    spark.catalog.dropTempView("taken")


@pytest.mark.parametrize("transform", [I.eye_transform((30.5, 40), (90, 71.25)), I.box_transform(150, 100, 260, 220), I.eye_transform((5, 5), (5, 60))])
def test_crops_pixel_by_pixel(transform):
    rgb = picture()
    assert np.allclose(I.warp(rgb, transform), crop(rgb, transform), atol=1e-6)


def test_eyes_land_on_the_template():
    for left, right in (((30, 40), (90, 70)), ((90, 70), (30, 40)), ((50, 90), (50, 20))):
        m = I.eye_transform(left, right)
        a, b = sorted((left, right), key=lambda p: p[0])
        ends = np.array([m @ [*a, 1], m @ [*b, 1]])
        assert np.allclose(ends.mean(0), (np.array(I.LEFT_EYE) + I.RIGHT_EYE) / 2) and ends[0, 0] < ends[1, 0] and np.isclose(ends[0, 1], ends[1, 1])
    assert np.allclose(I.eye_transform((50.7, 60.2), (51.2, 60.4)), I.box_transform(10, 20, 90, 100))


def test_pictures_are_drawn_a_few_at_a_time(spark, monkeypatch):
    """A batch of short texts makes many times its bytes of pixels, which one task held at once before."""
    from millrace import queries_more as Q

    frame = type(spark.range(1))
    seen, plain = [], frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, function, *a, **k: seen.append(function) or plain(df, function, *a, **k))
    monkeypatch.setattr(Q, "_texts", lambda s, d: s.range(100).selectExpr("id AS doc_id", "concat('text ', id) AS text"))
    Q.face_scan(spark, "")
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([f"text {k}" for k in range(100)]), pa.nulls(100)], names=["origin", "text", "detections"])
    sizes = [len(out) for out in seen[0](iter([batch]))]
    assert sum(sizes) == 100 and max(sizes) <= Q._PICTURES


def test_pictures_and_crops_equal_their_plain_forms(monkeypatch):
    """Pictures in bytes against sums of whole numbers, whatever the text's length; crops of part of a picture read that part alone."""
    from millrace import queries_more as Q

    rng = np.random.default_rng(7)
    for n in (0, 1, 1023, 1024, 1025, 5000, 300_000):
        text = "".join(map(chr, rng.integers(32, 300, n)))
        raw = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
        k, cells = np.arange(len(raw)), 32 * 32
        for c, plane in enumerate(Q._picture(text, 32).transpose(2, 0, 1)):
            total = np.bincount(k % cells, weights=raw * (k // cells + c + 1), minlength=cells).astype(np.int64)
            assert (plane.ravel() == (total + np.arange(cells) * (7 + c)) % 256).all() and (Q._pixels(text, 32, c) == plane).all()
    rgb, copied, plain = picture(), [], np.ascontiguousarray
    monkeypatch.setattr(np, "ascontiguousarray", lambda a, *x: copied.append(a.size) or plain(a, *x))
    I.warp(rgb, I.box_transform(10, 10, 40, 40))
    assert copied and max(copied) < rgb.size / 4
    for box in ((-500, -500, -400, -400), (5000, 20, 5100, 90)):
        assert not I.warp(rgb, I.box_transform(*box)).any()
