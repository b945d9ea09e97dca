"""Proposed folders by person and by month, and reviewable action tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.functions.scalar import PERSON, captured_at, month_name, month_stamp, sanitize_folder, sanitize_move
from millrace.operators.ranked import numbered
from millrace.storage import Workspace, scratch


def by_people(members: DataFrame, least: int = 2, ws: Workspace | None = None) -> DataFrame:
    """``key, suggestedName, photoId`` from ``clusterId, personId, name, photoId``: people in order of distinct photos, faces
    and cluster; a photo goes to its first person even where that person's folder is too small to be kept. Ranks and
    running numbers come from sorts by ranges, as there may be a cluster for every face."""
    ws = scratch(members.sparkSession, "by-people", ws)
    people = members.groupBy("clusterId").agg(F.max("personId").alias("personId"), F.max("name").alias("name"), F.count_distinct("photoId").alias("photos"), F.count("*").alias("faces"))
    ranked = ws.save(numbered(people, [F.col("photos").desc(), F.col("faces").desc(), "clusterId"], "rank", ws), "ranked")
    claimed = ws.save(members.select("clusterId", "photoId").distinct().join(ranked.select("clusterId", "rank"), "clusterId").groupBy("photoId").agg(F.min("rank").alias("rank")), "claimed")
    kept = claimed.groupBy("rank").agg(F.count("*").alias("n")).where(F.col("n") >= least).join(ranked, "rank").select("rank", "clusterId", "personId", "name")
    blank = F.trim(F.coalesce("name", F.lit(""))) == ""
    kept = ws.save(kept.withColumn("blank", blank), "kept")
    counted = numbered(kept.where("blank").select("rank", "clusterId", "personId"), ["rank"], "number", ws)
    unnamed = counted.withColumn("suggestedName", F.concat(F.lit(f"{PERSON} "), (F.col("number") + 1).cast("string"))).drop("number")
    every = kept.where("not blank").select("rank", "clusterId", "personId", F.col("name").alias("suggestedName")).unionByName(unnamed)
    key = F.concat(F.lit("person-"), F.col("personId").cast("string"))
    return claimed.join(every, "rank").select(key.alias("key"), "suggestedName", "clusterId", "photoId")


def by_months(photos: DataFrame) -> DataFrame:
    """``key, suggestedName, n, first_id`` per month, newest first. The key counts months from zero."""
    stamp = month_stamp(captured_at(F.col("dateTaken"), F.col("dateModified")))
    grouped = photos.withColumn("stamp", stamp).groupBy("stamp").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return grouped.select(F.concat(F.lit("month-"), F.col("stamp").cast("string")).alias("key"), month_name(F.col("stamp")).alias("suggestedName"), "n", "first_id", "stamp").orderBy(F.col("stamp").desc()).drop("stamp")


def month_members(photos: DataFrame) -> DataFrame:
    stamp = month_stamp(captured_at(F.col("dateTaken"), F.col("dateModified")))
    return photos.select(F.concat(F.lit("month-"), stamp.cast("string")).alias("key"), month_name(stamp).alias("suggestedName"), F.col("id").alias("photoId"))


def chosen(plan: DataFrame) -> DataFrame:
    """Folders that are enabled and have a name."""
    return plan.where("enabled and trim(name) <> ''")


def with_choice(plan: DataFrame, key: str, name: str | None = None, enabled: bool | None = None) -> DataFrame:
    """A proposed folder renamed, or switched on or off."""
    here = F.col("key") == key
    out = plan.withColumn("name", F.when(here, F.lit(name)).otherwise(F.col("name"))) if name is not None else plan
    return out.withColumn("enabled", F.when(here, F.lit(enabled)).otherwise(F.col("enabled"))) if enabled is not None else out


def chosen_count(plan: DataFrame) -> DataFrame:
    """One row: chosen folders and the photos in them; ``plan`` has a row per folder and photo."""
    return chosen(plan).agg(F.count_distinct("key").alias("folders"), F.count("photoId").alias("photos"))


def removal_plan(photos: DataFrame, to_trash: bool = True) -> DataFrame:
    """What a removal would do: folder-backed rows are deleted, catalogue rows trashed or deleted."""
    action = F.when(F.col("docUri").isNotNull(), "delete_document").when(F.lit(to_trash), "trash").otherwise("delete")
    return photos.select(action.alias("action"), "id", F.col("size").alias("bytes"))


def move_plan(photos: DataFrame, album: str) -> DataFrame:
    action = F.when(F.col("docUri").isNotNull(), "copy_then_delete").otherwise("relocate")
    return photos.select(action.alias("action"), "id", F.col("size").alias("bytes"), F.concat(F.lit("Pictures/"), sanitize_move(F.lit(album)), F.lit("/")).alias("target"))


def organise_plan(folders: DataFrame, photos: DataFrame) -> DataFrame:
    """One row per photo of the chosen folders; folder-backed rows can't be moved in place and say so."""
    joined = folders.join(photos.select(F.col("id").alias("photoId"), "docUri", F.col("size").alias("bytes")), "photoId")
    action = F.when(F.col("docUri").isNotNull(), "unsupported").otherwise("relocate")
    return joined.select(action.alias("action"), "photoId", "bytes", F.concat(F.lit("Pictures/"), sanitize_folder(F.col("suggestedName")), F.lit("/")).alias("target"))


def freed(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
