"""What a caller looks up in or selects from stored tables and groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from millrace.functions import scalar as S
from millrace.operators import exact, people, regroup, snapshot


def derived(photos: DataFrame) -> DataFrame:
    """``photos`` with ``fromFolder, capturedAt, pixels, hasSignature``."""
    return photos.withColumns({
        "fromFolder": F.col("docUri").isNotNull(), "capturedAt": S.captured_at(F.col("dateTaken"), F.col("dateModified")),
        "pixels": F.col("width").cast("bigint") * F.col("height"), "hasSignature": F.col("colorSig").isNotNull() & (F.col("sigVersion") >= 1),
    })


def face_sizes(faces: DataFrame) -> DataFrame:
    return faces.withColumn("width", F.col("r") - F.col("l")).withColumn("height", F.col("b") - F.col("t"))


def rows_of(photos: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of these ids; unknown ids have none."""
    return photos.join(ids.select("id"), "id", "left_semi")


def group_of_keeper(members: DataFrame, keeper_id: int) -> DataFrame:
    """Members of the group that this row keeps; empty when the group is gone."""
    return members.where(F.col("keeper_id") == keeper_id)


def person_of_cluster(view: DataFrame, cluster_id: int) -> DataFrame:
    return view.where(F.col("clusterId") == cluster_id)


def previews(members: DataFrame, shown: int = 3) -> DataFrame:
    """``set_id, first, overflow``: the first others of each group in order of place, and how many are left.
    ``members``: set_id, id, place (from 0, the keeper's)."""
    others = members.where("place > 0")
    head = others.where(F.col("place") <= shown).groupBy("set_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("first"))
    counts = others.groupBy("set_id").agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("overflow"))
    return head.join(counts, "set_id")


def total_waste(**groups: DataFrame) -> DataFrame:
    """``kind, groups, members, reclaimable`` of each table of groups, by name."""
    rows = [exact.waste(df).select(F.lit(kind).alias("kind"), "*") for kind, df in groups.items()]
    return reduce(DataFrame.unionByName, rows)


def counts(photos: DataFrame, faces: DataFrame, in_scope: DataFrame) -> DataFrame:
    """One row: stored photos, stored faces, photos in scope."""
    one = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("_one", F.lit(1))
    return one(photos, "photos").join(one(faces, "faces"), "_one").join(one(in_scope, "scoped"), "_one").drop("_one")


def select(selection: DataFrame, action: str, ids: DataFrame) -> DataFrame:
    """A selection of ids after an action: ``add``, ``subtract``, or ``toggle`` (take all out if all are in, else add)."""
    if action == "toggle":
        action = "add" if ids.select("id").join(selection, "id", "left_anti").limit(1).count() else "subtract"
    if action == "add":
        return selection.select("id").union(ids.select("id")).distinct()
    return selection.select("id").join(ids.select("id"), "id", "left_anti")


def selected_bytes(photos: DataFrame, selection: DataFrame) -> DataFrame:
    return rows_of(photos, selection).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def forget(photos: DataFrame, faces: DataFrame, face_scan: DataFrame, names: DataFrame, ids: DataFrame, solved: regroup.Solved | None = None) -> dict[str, DataFrame]:
    """Drop rows after an action and look again: the three tables without them, exact groups, albums, people and, where
    photos have signatures, similar groups with their components. With the similar groups as they were (``solved``) only
    those that lost a row are solved again."""
    kept = snapshot.cascade_delete({"photos": (photos, "id"), "faces": (faces, "photoId"), "face_scan": (face_scan, "photoId")}, ids)
    if solved or "phash" in photos.columns:
        now = regroup.without(solved, photos, ids) if solved else regroup.solve(kept["photos"])
        kept |= {"similar": now.groups, "components": now.components}
    return kept | {"groups": exact.exact_groups(kept["photos"]), "albums": snapshot.album_list(kept["photos"]), "people": people.people_view(kept["faces"], names)}
