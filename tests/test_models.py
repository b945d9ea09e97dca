"""Models that workers load themselves."""

import os
import pickle

import numpy as np
import pytest

from millrace import config as C
from millrace.functions import images as I
from millrace.sources import catalogue
from tests import fake_model
from tests.test_more import jpeg

LOADER = "tests.fake_model:load"
FOUND = "origin string, l int, t int, r int, b int, yaw double, roll double, lx double, ly double, rx double, ry double"


def model(path, log, dim=64):
    path.write_text(f"{log}\n{dim}\n" + "x" * 2000)
    return str(path)


def test_each_worker_loads_a_model_once(spark, tmp_path):
    log = tmp_path / "loads"
    path = model(tmp_path / "m.bin", log)
    with pytest.raises(TypeError):
        pickle.dumps(fake_model.load(path)[0])
    name = I.shipped_embedder(spark, None, str(tmp_path / "missing"), path, loader=LOADER)
    assert name == path and I.EMBEDDERS[name][1:] == (64, C.model_version(os.path.getsize(path), 64))
    log.unlink()
    os.remove(path)  # workers have their own copy
    y, x = np.mgrid[0:160, 0:200]
    jpeg(spark, tmp_path / "f.jpg", np.stack([x, y, x // 2 + y // 2], -1) % 256)
    decoded = catalogue.read_images(spark, str(tmp_path / "f.jpg"))
    origin = decoded.first().origin
    found = spark.createDataFrame([(origin, 40 + k % 3, 30, 140, 130, 5.0, 3.0, 70.0, 70.0, 110.0, 70.0) for k in range(200)], FOUND)
    many = decoded.repartition(1)
    faces = catalogue.face_rows(many, found.repartition(8), name)
    for _ in range(2):
        rows = faces.collect()
        assert len(rows) == 200 and {len(r.embedding) for r in rows} == {64} and {r.embVersion for r in rows} == {I.EMBEDDERS[name][2]}
    pids = log.read_text().split()
    assert pids and len(pids) == len(set(pids)) and str(os.getpid()) not in pids


def test_a_staged_model_is_promoted_or_leaves_all_as_it_was(spark, tmp_path):
    path = model(tmp_path / "n.bin", tmp_path / "loads", 48)
    version = C.model_version(os.path.getsize(path), 48)
    faces, scans = (spark.createDataFrame([(1, 1), (2, version), (3, None)], f"{k} bigint, embVersion int") for k in ("faceId", "photoId"))
    name, kept, scanned = I.promote(spark, path, faces, scans, LOADER)
    assert name == path and [r.faceId for r in kept.collect()] == [r.photoId for r in scanned.collect()] == [2]
    before = dict(I.EMBEDDERS)
    for bad in (model(tmp_path / "wide.bin", tmp_path / "loads", 4096), str(tmp_path / "none")):
        with pytest.raises(ValueError):
            I.promote(spark, bad, faces, scans, LOADER)
    assert before == I.EMBEDDERS and I.shipped_embedder(spark, None, str(tmp_path / "none"), loader=LOADER) == "hog"


def test_a_new_file_under_an_old_path_is_another_model(spark, tmp_path):
    path = model(tmp_path / "m.bin", tmp_path / "loads", 64)
    first = I.EMBEDDERS[I.ship_model(spark, path, LOADER)][0]
    model(tmp_path / "m.bin", tmp_path / "loads", 32)
    second = I.EMBEDDERS[I.ship_model(spark, path, LOADER)][0]
    assert first.file != second.file and [len(f(np.zeros((4, 4, 3)))) for f in (first, second, first)] == [64, 32, 64]
