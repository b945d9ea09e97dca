"""Byte-exact duplicates: tiers of size, head hash and full hash; groups with a keeper."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from millrace.config import HEAD_BYTES, KeeperRule
from millrace.functions.scalar import quality_score
from millrace.operators.ranked import placed
from millrace.operators.snapshot import write_sha
from millrace.storage import Workspace, scratch


def keeper(rule: KeeperRule, *columns: str) -> Column:
    """These columns of the keeper as an aggregate, so that groups are combined before they are shuffled."""
    score = quality_score(F.col("width"), F.col("height"), F.col("size"))
    taken = F.struct(*columns)
    if rule is KeeperRule.BEST_QUALITY:
        return F.max_by(taken, F.struct(score, -F.col("dateModified"), -F.col("id")))
    if rule is KeeperRule.OLDEST:
        return F.min_by(taken, F.struct("dateModified", "id"))
    return F.max_by(taken, F.struct(F.col("dateModified"), -F.col("id")))


def keeper_id(rule: KeeperRule) -> Column:
    return keeper(rule, "id")["id"]


def exact_groups(photos: DataFrame, rule: KeeperRule = KeeperRule.BEST_QUALITY) -> DataFrame:
    """``sha, keeper_id, n, reclaimable``: groups of two or more with the same content hash, largest saving first."""
    grouped = photos.where("sha is not null").groupBy("sha").agg(keeper(rule, "id", "size").alias("k"), F.count("*").alias("n"), F.sum("size").alias("total"))
    rows = grouped.where("n > 1").select("sha", F.col("k.id").alias("keeper_id"), "n", (F.col("total") - F.col("k.size")).alias("reclaimable"))
    return rows.orderBy(F.col("reclaimable").desc(), "keeper_id")


def exact_members(photos: DataFrame, rule: KeeperRule = KeeperRule.BEST_QUALITY, ws: Workspace | None = None) -> DataFrame:
    """Long form: every member with its place; the keeper is first, the others follow by quality, then id. The places come
    from one sort by ranges, so the rows of a very large group are spread over tasks."""
    ws = scratch(photos.sparkSession, "exact", ws)
    keyed = photos.where("sha is not null")
    groups = exact_groups(keyed, rule).select("sha", "keeper_id")
    score = -quality_score(F.col("width"), F.col("height"), F.col("size"))
    rows = keyed.select("sha", "id", score.alias("minus")).join(groups, "sha").withColumn("is_keeper", F.col("id") == F.col("keeper_id")).withColumn("after", F.when(F.col("is_keeper"), 0).otherwise(1))
    members = placed(rows, "sha", ["after", "minus", "id"], ws)
    return members.select("sha", "id", "keeper_id", "is_keeper", F.lit(0).alias("distance"), "place")


def waste(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable"))


def _collisions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs twice or more; counted with partial sums and joined back, so a hot key is no hot window."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("same")).where("same > 1")
    return df.join(counts, keys)


def size_tier(photos: DataFrame) -> DataFrame:
    return _collisions(photos, ["size"])


def head_hash(content: Column, limit: int = HEAD_BYTES) -> Column:
    return F.sha2(F.substring(content, 1, limit), 256)


def head_tier(candidates: DataFrame, head: str = "head") -> DataFrame:
    """Rows of the size tier whose (size, head) collides; unreadable heads of one size share a bucket."""
    keyed = candidates.drop("same").withColumn(head, F.coalesce(F.col(head), F.lit("?")))
    return _collisions(keyed, ["size", head])


def tiered(photos: DataFrame, heads: Callable[[DataFrame], DataFrame], hashes: Callable[[DataFrame], DataFrame], ws: Workspace | None = None) -> DataFrame:
    """``photos`` with the hashes that exact duplicates need: of rows of one size the heads are read, of rows of one size and
    head, where their hash is unknown, the whole content. ``heads`` and ``hashes`` take the rows to read and return
    ``id, head`` and ``id, sha``. A size whose rows all have their hash is not read at all, as its heads would change
    nothing."""
    ws = scratch(photos.sparkSession, "tiers", ws)
    same = ws.save(size_tier(photos), "size-tier")
    unknown = same.where("sha is null").select("size").distinct()
    wanted = same.join(unknown, "size", "left_semi")
    head = ws.save(heads(wanted).select("id", "head"), "heads")
    full = ws.save(needs_full_hash(head_tier(wanted.join(head, "id", "left"))), "head-tier")
    return write_sha(photos, ws.save(hashes(full).select("id", "sha"), "hashes"))


def needs_full_hash(candidates: DataFrame) -> DataFrame:
    return candidates.where("sha is null")
