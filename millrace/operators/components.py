"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.storage import Workspace


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    """``~u`` and the least of u and its neighbours. The complemented key makes the next join deal out both sides
    itself, so that adaptive execution may split the partition of a node with very many neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return least.select(F.bitwise_not("u").alias("k"), F.least("u", "m").alias("m"))


def _with_smallest(edges: DataFrame) -> DataFrame:
    return edges.withColumn("k", F.bitwise_not("u")).join(_smallest_neighbour(edges), "k").select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    joined = _with_smallest(edges)
    pairs = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return pairs.select("e.u", "e.v").where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", workspace: Workspace | None = None) -> DataFrame:
    """Label every node that has an edge with the smallest node id that it reaches.

    ``edges``: two bigint columns, read as undirected; self loops, repeats, nulls and extra columns are ignored.
    Returns ``node, component``; an empty edge table gives an empty result. Each step writes its edges to the
    shared folder, so plans stay short and a lost executor repeats one step at most.
    """
    ws = workspace or Workspace(edges.sparkSession, "components")
    a, b = F.col(src).cast("bigint"), F.col(dst).cast("bigint")
    now = ws.save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v and v is not null").distinct(), "edges")
    state = None
    while True:
        fingerprint = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if fingerprint == state or not fingerprint[0]:
            break
        state = fingerprint
        large = ws.save(_large_star(now), "large")
        small = ws.save(_small_star(large), "small")
        ws.drop(now, large)
        now = small
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
