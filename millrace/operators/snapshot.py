"""Versioned catalogue: snapshot merge, cascades, column writes, work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from millrace.operators.ranked import numbered
from millrace.storage import Workspace, scratch

#: Columns that a touch refreshes, and the cleared values of a new or changed row.
TOUCHED = ("name", "bucket", "relPath", "width", "height", "dateAdded", "dateTaken", "mime")
CLEARED = {"sha": None, "dhash": 0, "phash": 0, "colorSig": None, "sigVersion": 0}


def first_per_id(fresh: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per id: the first in the given order (an aggregate, so repeated ids are combined before they are shuffled)."""
    row = F.struct(*fresh.columns)
    best = F.min_by(row, F.struct(*(order or [c for c in fresh.columns if c != "id"])))
    return fresh.groupBy("id").agg(best.alias("_row")).select("_row.*")


def merge_snapshot(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The next version of the catalogue and what became of each row (``outcome``: touched, changed, new, gone).

    Unchanged size and time keep hashes and signatures and refresh the rest; new or changed rows lose them; vanished
    rows stay in the result as ``gone``, for the cascade. Both sides have one row per id.
    """
    f = fresh.select(F.col("id").alias("f_id"), *[F.col(c).alias(f"f_{c}") for c in stored.columns if c != "id" and c in fresh.columns])
    joined = stored.join(f, F.col("id") == F.col("f_id"), "full_outer")
    gone, new = F.col("f_id").isNull(), F.col("id").isNull()
    same = (F.col("size") == F.col("f_size")) & (F.col("dateModified") == F.col("f_dateModified"))
    outcome = F.when(gone, "gone").when(new, "new").when(same, "touched").otherwise("changed")
    kinds, out = dict(stored.dtypes), []
    for c in stored.columns:
        if c == "id":
            col = F.coalesce("id", "f_id")
        elif c in CLEARED:
            cleared = F.lit(CLEARED[c]).cast(kinds[c])
            col = F.when(gone | same, F.col(c)).otherwise(cleared)
        elif f"f_{c}" in f.columns and c != "docUri":
            col = F.when(gone, F.col(c)).otherwise(F.col(f"f_{c}").cast(kinds[c]))
        elif c == "docUri" and "f_docUri" in f.columns:
            col = F.when(gone | same, F.col(c)).otherwise(F.col("f_docUri"))
        else:
            col = F.col(c)
        out.append(col.alias(c))
    return joined.select(*out, outcome.alias("outcome"))


def gone_ids(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    return stored.select("id").join(fresh.select("id"), "id", "left_anti")


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table (frame, key column) without the rows of ``ids``."""
    return {name: df.join(ids.select(F.col("id").alias("_gone")), F.col(key) == F.col("_gone"), "left_anti") for name, (df, key) in tables.items()}


def write_sha(photos: DataFrame, rows: DataFrame) -> DataFrame:
    new = rows.select(F.col("id").alias("_id"), F.col("sha").alias("_sha"))
    return photos.join(new, F.col("id") == F.col("_id"), "left").withColumn("sha", F.coalesce("_sha", "sha")).drop("_id", "_sha")


def write_signatures(photos: DataFrame, rows: DataFrame, version: int) -> DataFrame:
    new = rows.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("dhash", "phash", "colorSig")])
    hit = F.col("_id").isNotNull()
    joined = photos.join(new, F.col("id") == F.col("_id"), "left")
    for c in ("dhash", "phash", "colorSig"):
        joined = joined.withColumn(c, F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)))
    return joined.withColumn("sigVersion", F.when(hit, F.lit(version)).otherwise(F.col("sigVersion"))).select(*photos.columns)


def write_clusters(faces: DataFrame, rows: DataFrame) -> DataFrame:
    """Set cluster and person by face; pinned faces too, as the clustering has honoured their pins already."""
    new = rows.select(F.col("faceId").alias("_id"), F.col("clusterId").alias("_cluster"), F.col("personId").alias("_person"))
    joined = faces.join(new, F.col("faceId") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    put = {"clusterId": "_cluster", "personId": "_person"}
    return joined.select(*[F.when(hit, F.col(put[c])).otherwise(F.col(c)).cast(faces.schema[c].dataType).alias(c) if c in put else F.col(c) for c in faces.columns])


def migrate(table: DataFrame, schema: str) -> DataFrame:
    """A stored table in the present schema: missing columns come as null, others are cast, unknown ones go."""
    have = {c.lower() for c in table.columns}
    wanted = StructType.fromDDL(schema)
    return table.select(*[(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields])


def needs_signature(photos: DataFrame, version: int) -> DataFrame:
    return photos.where((F.col("sigVersion") < version) | F.col("colorSig").isNull())


def scanned(face_scan: DataFrame, photos: DataFrame, version: int) -> DataFrame:
    """Ids whose checkpoint is of this version and of the photo's present file time."""
    p = photos.select(F.col("id").alias("p_id"), F.col("dateModified").alias("p_time"))
    return face_scan.where(F.col("embVersion") == version).join(p, (F.col("photoId") == F.col("p_id")) & (F.col("dateModified") == F.col("p_time"))).select(F.col("photoId").alias("id")).distinct()


def faces_needing_scan(photos: DataFrame, face_scan: DataFrame, version: int) -> DataFrame:
    return photos.join(scanned(face_scan, photos, version), "id", "left_anti")


def replace_faces(faces: DataFrame, face_scan: DataFrame, detected: DataFrame, checkpoints: DataFrame, ws: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """Replace all faces of the scanned photos; new ones are unassigned, unnamed and unpinned, with ids after the last, in
    order of photo and box."""
    ws = scratch(faces.sparkSession, "replace-faces", ws)
    seen = checkpoints.select(F.col("photoId").alias("_p")).distinct()
    last = faces.agg(F.coalesce(F.max("faceId"), F.lit(0))).first()[0]
    fresh = numbered(detected, ["photoId", "l", "t", "r", "b"], "_n", ws)
    fresh = fresh.select((F.lit(last) + 1 + F.col("_n")).cast("bigint").alias("faceId"), "photoId", "l", "t", "r", "b", "quality", "embedding", "embVersion", F.lit(-1).alias("clusterId"), F.lit(0).cast("bigint").alias("personId"), F.lit(False).alias("pinned"))
    kept = faces.join(seen, F.col("photoId") == F.col("_p"), "left_anti")
    scans = face_scan.join(seen, F.col("photoId") == F.col("_p"), "left_anti").unionByName(checkpoints)
    return kept.unionByName(fresh), scans


def purge_versions(table: DataFrame, version: int) -> DataFrame:
    return table.where(F.col("embVersion") == version)


def clear(table: DataFrame) -> DataFrame:
    return table.limit(0)


def in_scope(photos: DataFrame, roots: tuple[str, ...] = (), excluded: tuple[str, ...] = (), strict_prefix: bool = False) -> DataFrame:
    """Rows under any root (a plain string prefix unless ``strict_prefix``) or from a picked folder, minus excluded albums."""
    keep = F.lit(True)
    if roots:
        keep = F.col("docUri").isNotNull()
        for root in roots:
            under = F.col("relPath").startswith(root.rstrip("/") + "/") | (F.col("relPath") == root) if strict_prefix else F.col("relPath").startswith(root)
            keep = keep | under
    return photos.where(keep & ~F.col("bucket").isin(*excluded)) if excluded else photos.where(keep)


def album_list(photos: DataFrame, roots: tuple[str, ...] = ()) -> DataFrame:
    return in_scope(photos, roots).groupBy("bucket").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "bucket")
