"""Catalogue and folder sources, image signatures and face descriptors."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

from millrace.config import HEAD_BYTES
from millrace.functions import images, scalar as S
from millrace.operators import exact
from millrace.sources import files as disk
from millrace.sources.faces import DETECTIONS, photo_faces, pixels
from millrace.sources.walk import breadth_first, files_below, levels, whole
from millrace.storage import Workspace

#: Levels below a picked root; files that the original takes from a root (``max_files`` restores that).
MAX_DEPTH, MAX_FILES = 12, 60_000
#: Least short side of a picture that is hashed.
HASH_SIDE = 96


def scan_catalogue(rows: DataFrame) -> DataFrame:
    """Listed rows with content, the one with the least id of each path (rows without a path all pass), nulls filled."""
    listed = rows.where("size > 0")
    first = listed.where("relPath <> ''").groupBy("relPath").agg(F.min_by(F.struct(*rows.columns), "id").alias("_row")).select("_row.*")
    named = first.unionByName(listed.where("relPath is null or relPath = ''"))
    blank = lambda c, other: F.coalesce(F.col(c), other)
    return (
        named.withColumn("name", blank("name", S.root_label(F.col("relPath")))).withColumn("bucket", blank("bucket", S.folder_label(F.col("relPath"))))
        .withColumn("dateTaken", blank("dateTaken", F.lit(0))).withColumn("mime", blank("mime", F.lit("image/*")))
    )


def synthetic_id(uri: Column) -> Column:
    def ids(s: pd.Series) -> pd.Series:
        return s.map(images.synthetic_id, na_action="ignore")

    return F.pandas_udf(ids, LongType())(uri)


def accepted(files: DataFrame, root: str, max_depth: int = MAX_DEPTH, max_files: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """Catalogue rows of a listing (``uri, rel, length, millis, mime``): files with content that say that they are images,
    or whose name does, unless a part of their path is hidden or lies too deep. Of those that ``known`` lacks, ``max_files``
    keeps the first that a breadth-first walk meets."""
    parts = F.split("rel", "/")
    name = F.element_at(parts, -1)
    image = F.coalesce(F.col("mime").startswith("image/"), F.lit(False))
    keep = ~F.exists(parts, S.is_hidden) & (F.size(parts) <= max_depth + 1) & (image | S.extension(name).isin(*S.IMAGE_EXTENSIONS)) & (F.col("length") > 0)
    path = F.concat(F.lit(root.rstrip("/") + "/"), "rel")
    found = files.where(keep)
    if known is not None:
        found = not_known(found.select("*", path.alias("relPath"), name.alias("name"), F.col("length").alias("size")), known).select(*files.columns)
    found = found.orderBy(*breadth_first()).limit(max_files) if max_files else found
    seconds = F.floor(F.col("millis") / 1000).cast("bigint")
    return found.select(
        synthetic_id(F.col("uri")).alias("id"), name.alias("name"), S.folder_label(path).alias("bucket"), path.alias("relPath"), F.col("length").alias("size"),
        F.lit(0).alias("width"), F.lit(0).alias("height"), seconds.alias("dateAdded"), seconds.alias("dateModified"), F.lit(0).cast("bigint").alias("dateTaken"),
        F.when(image, F.col("mime")).otherwise(F.lit("image/*")).alias("mime"), F.col("uri").alias("docUri"),
    )


def walk(spark: SparkSession, root: str, max_depth: int = MAX_DEPTH, max_files: int | None = None, known: DataFrame | None = None, ws: Workspace | None = None) -> DataFrame:
    """Image files below a root, without those that ``known`` has. Folders that can't be listed are skipped, the root too.
    With ``max_files`` no level is listed beyond the one that reaches that number."""
    base = root.removeprefix("file:")
    images_in = lambda found, most=None: accepted(files_below(spark, root, found), base, max_depth, most, known)
    enough = (lambda found: images_in(found).limit(max_files).count() >= max_files) if max_files else None
    return images_in(whole(levels(spark, root, max_depth, enough, ws)), max_files)


def not_known(walked: DataFrame, known: DataFrame) -> DataFrame:
    """Walked files that the catalogue lacks. Known means: same path, or, without a path, same name and size."""
    with_path = walked.where("relPath is not null").join(known.select("relPath").distinct(), "relPath", "left_anti")
    without = walked.where("relPath is null").join(known.select("name", "size").distinct(), ["name", "size"], "left_anti")
    return with_path.unionByName(without)


def first_of_roots(walked: list[DataFrame]) -> DataFrame:
    """The rows of all roots, of each id the one of the first root."""
    every = functools.reduce(DataFrame.unionByName, [df.withColumn("_root", F.lit(k)) for k, df in enumerate(walked)])
    return every.groupBy("id").agg(F.min_by(F.struct(*walked[0].columns), "_root").alias("_row")).select("_row.*")


def walk_roots(spark: SparkSession, roots: list[str], known: DataFrame, max_files: int | None = None) -> DataFrame | None:
    """Files of all roots that the catalogue lacks, ``max_files`` of each root at most; none of a root that can't be listed."""
    walked = [walk(spark, root, max_files=max_files, known=known) for root in roots]
    return first_of_roots(walked) if walked else None


def whole_catalogue(rows: DataFrame, walked: DataFrame | None) -> DataFrame:
    """Catalogue rows and the walked files that they lack."""
    scanned = scan_catalogue(rows)
    return scanned if walked is None else scanned.unionByName(not_known(walked, scanned), allowMissingColumns=True)


def read_bytes(paths: DataFrame, limit: int | None = None) -> DataFrame:
    """``path, content``: the first ``limit`` bytes of each file, or all; null where a file can't be read. No more is read
    than is asked for, and no file but the given ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():  # one file at a time, as whole files may be large
                try:
                    system, where = disk.place(path)
                    with system.open_input_file(where) as f:
                        content = f.read(limit) if limit is not None else f.read()
                except disk.UNREADABLE:
                    content = None
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([content], pa.binary())], names=["path", "content"])

    return paths.select("path").mapInArrow(run, "path string, content binary")


def content_hash(paths: DataFrame, limit: int | None = None) -> DataFrame:
    """``path, hash, bytes_read``: SHA-256 of the first ``limit`` bytes, or of all. Files are hashed where they are read, a
    chunk at a time, so their size doesn't matter and no content enters a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [disk.digest(path, limit) if path is not None else (None, None) for path in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], names=["path", "hash", "bytes_read"])

    return paths.select("path").mapInArrow(run, "path string, hash string, bytes_read bigint")


def tiered_hashes(photos: DataFrame, head: int = HEAD_BYTES, ws: Workspace | None = None) -> DataFrame:
    """Catalogue rows (with their file's address in ``docUri``) with the hashes that exact duplicates need: heads of files
    of one size, whole files only of one size and head."""
    by_uri = lambda df, limit, name: df.select("id", "docUri").join(content_hash(df.select(F.col("docUri").alias("path")), limit), F.col("docUri") == F.col("path")).select("id", F.col("hash").alias(name))
    return exact.tiered(photos, lambda df: by_uri(df, head, "head"), lambda df: by_uri(df, None, "sha"), ws)


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images; unreadable files are dropped."""
    return spark.read.format("image").option("dropInvalid", "true").load(root).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")


def orientations(decoded: DataFrame, head: int = HEAD_BYTES) -> DataFrame:
    """``decoded`` with ``degrees``, the turn that each file's head states."""
    degrees = F.pandas_udf(lambda s: s.map(lambda c: images.orientation_degrees(bytes(c)) if c is not None else 0), "int")
    heads = read_bytes(decoded.select(F.col("origin").alias("path")), head).select(F.col("path").alias("origin"), degrees("content").alias("degrees"))
    return decoded.join(heads, "origin", "left").withColumn("degrees", F.coalesce("degrees", F.lit(0)))


def signatures(decoded: DataFrame) -> DataFrame:
    """``origin, dhash, phash, colorSig`` of decoded images, subsampled and turned by ``degrees`` where there are any; all
    null where an image can't be handled."""
    turned = decoded if "degrees" in decoded.columns else decoded.withColumn("degrees", F.lit(0))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                try:
                    small = images.subsampled(pixels(r.width, r.height, r.nChannels, r.data), HASH_SIDE)
                    rows.append((r.origin, *images.signature(images.upright(small, r.degrees))))
                except (AttributeError, ValueError, IndexError, ZeroDivisionError):
                    rows.append((r.origin, None, None, None))
            yield pd.DataFrame(rows, columns=["origin", "dhash", "phash", "colorSig"]).astype({"dhash": "Int64", "phash": "Int64"})

    return turned.select("origin", "width", "height", "nChannels", "data", "degrees").mapInPandas(run, "origin string, dhash bigint, phash bigint, colorSig array<int>")


def face_rows(decoded: DataFrame, detections: DataFrame, embedder: str = "hog") -> DataFrame:
    """Gate, align and embed detected faces. ``detections``: origin, l, t, r, b, yaw, roll and nullable eye points. A photo's
    detections are put together before they meet its pixels, which thus travel once; faces that can't be embedded are left out."""
    found = detections.groupBy("origin").agg(F.collect_list(F.struct("l", "t", "r", "b", "yaw", "roll", "lx", "ly", "rx", "ry")).cast(DETECTIONS).alias("detections"))
    return photo_faces(decoded.join(found, "origin"), embedder).where("embedding is not null").select("origin", "l", "t", "r", "b", F.col("quality").cast("float").alias("quality"), "embedding", "embVersion")
