"""Faces of photos by a table function: one photo goes in with its pixels once, a row for each of its faces comes out.

The gates, the quality and the stored box are built-in expressions over the array of detections; the table function does
the pixel work alone. ``register`` makes it known to SQL as ``align_faces``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions import images, scalar as S

#: Detections of a photo: box, turn of the head, eye points (null where not seen).
DETECTIONS = "array<struct<l:int,t:int,r:int,b:int,yaw:double,roll:double,lx:double,ly:double,rx:double,ry:double>>"
ALIGNED = "face int, l int, t int, r int, b int, quality double, transform array<double>, embedding array<float>, embVersion int"


def gated_faces(detections: Column, width: Column, height: Column) -> Column:
    """The detections that pass the gates, in their order: place among all, clipped box, eyes, quality and stored box. Null
    detections give null; a photo of unknown size has no such face."""

    def one(d: Column, place: Column) -> Column:
        box = {"cl": F.greatest(d["l"], F.lit(0)), "ct": F.greatest(d["t"], F.lit(0)), "cr": F.least(d["r"], width), "cb": F.least(d["b"], height)}
        w, h = box["cr"] - box["cl"], box["cb"] - box["ct"]
        has_eyes = d["lx"].isNotNull() & d["ly"].isNotNull() & d["rx"].isNotNull() & d["ry"].isNotNull()
        quality = S.face_quality(F.least(w, h) / F.least(width, height), d["yaw"], d["roll"], has_eyes)
        kept = F.coalesce((width > 0) & (height > 0) & S.face_gate(w, h, d["yaw"], d["roll"], has_eyes), F.lit(False))
        return F.struct(
            place.alias("face"), *[c.alias(k) for k, c in box.items()], *[F.when(has_eyes, d[k]).alias(k) for k in ("lx", "ly", "rx", "ry")],
            quality.alias("quality"), S.square_box(box["cl"], box["ct"], box["cr"], box["cb"], width, height).alias("box"), kept.alias("kept"),
        )

    return F.filter(F.transform(detections, one), lambda f: f["kept"])


def pixels(width: int, height: int, channels: int, data: bytes | None) -> np.ndarray | None:
    """Red, green and blue of stored pixels (grey, or blue first); None where they don't fit the frame."""
    if data is None or channels not in (1, 3, 4) or len(data) != width * height * channels or not data:
        return None
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(raw, 3, 2) if channels == 1 else raw[..., 2::-1]


def aligner(embedder: str = "hog"):
    """The table function ``(width, height, channels, data, gated faces)``: per face its stored box and quality, the transform
    to the template and the embedding of the aligned crop. A photo without usable pixels gives null embeddings."""
    function, _, version = images.EMBEDDERS[embedder]

    class Aligned:
        def eval(self, width: int, height: int, channels: int, data: bytes, faces: list):
            rgb = pixels(width, height, channels, data) if faces else None
            for f in faces or ():
                eyes = f["lx"] is not None
                m = images.eye_transform((f["lx"], f["ly"]), (f["rx"], f["ry"])) if eyes else images.box_transform(f["cl"], f["ct"], f["cr"], f["cb"])
                vector = None if rgb is None else np.asarray(function(images.warp(rgb, m))).tolist()
                box = f["box"]
                yield f["face"], box["l"], box["t"], box["r"], box["b"], f["quality"], m.ravel().tolist(), vector, None if rgb is None else version

    return F.udtf(Aligned, returnType=ALIGNED, useArrow=True)  # batches of a stated size, as photos are large


def register(spark: SparkSession, embedder: str = "hog", name: str = "align_faces") -> None:
    """Make the table function known to the session's SQL."""
    spark.udtf.register(name, aligner(embedder))


def photo_faces(photos: DataFrame, embedder: str = "hog") -> DataFrame:
    """``origin`` and the columns of ``ALIGNED``, one row per face that passes the gates. ``photos``: origin, width, height,
    nChannels, data, detections. Photos without such faces give no row, null detections neither."""
    ready = photos.select("origin", "width", "height", "nChannels", "data", gated_faces(F.col("detections"), F.col("width"), F.col("height")).alias("_faces")).where(F.size("_faces") > 0)
    found = ready.lateralJoin(aligner(embedder)(*[F.col(c).outer() for c in ("width", "height", "nChannels", "data", "_faces")]))
    return found.select("origin", *[x.split()[0] for x in ALIGNED.split(", ")])
