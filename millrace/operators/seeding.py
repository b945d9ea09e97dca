"""Greedy seeding of clusters in a given order, in blocks.

The greedy pass takes vectors one by one: each joins the cluster whose centroid is nearest, if near enough, which moves
that centroid, and else founds a cluster. Here the vectors come in blocks. Tasks compare a block with the table of clusters as
it was when the block began and return each vector's best few; the driver then goes through the block in order. Only
clusters that moved since (``hot``) are compared again there; of the others the tasks' answer still holds. Where a
vector's returned clusters have all moved, and one that wasn't returned could be the best, the block ends before that
vector and the next begins with it. So the result is that of the greedy pass whatever the block's size, and the
driver holds a block of vectors and about as many moved clusters. The order itself makes the blocks follow each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.storage import Workspace

#: Vectors of a block, clusters that tasks return for each, assignments that are written at once.
SEED_BLOCK, RETURNED, WRITTEN = 4096, 4, 1 << 20
_CENTERS = "clusterId bigint, total array<double>"


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.where(norm < 1e-8, x, x / np.maximum(norm, 1e-8))


def matrix(lists: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Lists of one length as rows."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values = lists.flatten() if len(lists) else pa.array([], pa.float64())
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), dim)


def list_array(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


class Hot:
    """Clusters that moved since the table was written, by the order in which they did."""

    def __init__(self, dim: int):
        self.ids, self.sums = np.zeros(64, np.int64), np.zeros((64, dim))
        self.cents, self.at, self.n = np.zeros((64, dim)), {}, 0

    def best(self, v: np.ndarray) -> tuple[float, int]:
        """Greatest cosine and its cluster, the later of equals."""
        if not self.n:
            return -np.inf, -1
        cosine = self.cents[: self.n] @ v
        top = cosine.max()
        return float(top), int(self.ids[: self.n][cosine == top].max())

    def move(self, cluster: int, v: np.ndarray, total: np.ndarray | None = None) -> None:
        """Add ``v`` to a cluster; ``total`` is the sum of one that wasn't hot."""
        k = self.at.get(cluster)
        if k is None:
            if self.n == len(self.ids):
                self.ids, self.sums, self.cents = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ids, self.sums, self.cents))
            k = self.at[cluster] = self.n
            self.ids[k], self.n = cluster, self.n + 1
            if total is not None:
                self.sums[k] = total
        self.sums[k] += v
        self.cents[k] = unit(self.sums[k])


def settle_block(vectors: np.ndarray, hot: Hot, answers: dict[int, list[tuple[float, int]]], totals: dict[int, np.ndarray], threshold: float, clusters: int, returned: int) -> list[int]:
    """The clusters of a block's vectors in order, as far as ``answers`` (by vector: cosine and cluster, best first, at most
    ``returned``) decide them: at least the first's."""
    out: list[int] = []
    for i, v in enumerate(vectors):
        cosine, cluster = hot.best(v)
        given = answers.get(i, ())
        still = next((x for x in given if x[1] not in hot.at), None)
        if still is None and len(given) == returned and cosine <= given[-1][0]:
            break
        if still is not None:
            cosine, cluster = max((cosine, cluster), still)
        if cluster < 0 or cosine < threshold:
            cluster, clusters = clusters, clusters + 1
        hot.move(cluster, v, totals.get(cluster))
        out.append(cluster)
    return out


class Centers:
    """The table of clusters: a table on disk, and the hot ones in place of their rows there."""

    def __init__(self, spark: SparkSession, dim: int, ws: Workspace):
        self.spark, self.dim, self.ws = spark, dim, ws
        self.table: DataFrame | None = None
        self.hot, self.n = Hot(dim), 0

    def _hot_table(self) -> DataFrame:
        h = self.hot
        return self.spark.createDataFrame(pa.table({"clusterId": pa.array(h.ids[: h.n]), "total": list_array(h.sums[: h.n])}), _CENTERS)

    def flush(self) -> DataFrame:
        """Write the hot clusters into the table."""
        new, old = self._hot_table(), self.table
        if old is not None:
            new = old.join(F.broadcast(new.select("clusterId")), "clusterId", "left_anti").unionByName(new)  # a block's clusters
        self.table, self.hot = self.ws.save(new, "centers"), Hot(self.dim)
        if old is not None:
            self.ws.drop(old)
        return self.table

    def answers(self, vectors: np.ndarray, threshold: float, returned: int) -> tuple[dict[int, list[tuple[float, int]]], dict[int, np.ndarray]]:
        """For each vector of a block the best ``returned`` clusters of the table that are near enough and not hot, and the
        sums of all these clusters."""
        if self.table is None:
            return {}, {}
        sent, dim = self.spark.sparkContext.broadcast((vectors, np.sort(self.hot.ids[: self.hot.n]))), self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, moved = sent.value
            for batch in batches:
                ids = np.asarray(batch.column(0))
                rest = ~np.isin(ids, moved)
                ids, cents = ids[rest], unit(matrix(batch.column(1), dim)[rest])
                cosine = block @ cents.T
                i, k = np.nonzero(cosine >= threshold)
                order = np.lexsort((-ids[k], -cosine[i, k], i))
                i, k = i[order], k[order]
                starts = np.searchsorted(i, i)  # where a vector's clusters begin
                some = np.arange(len(i)) - starts < returned
                i, k = i[some], k[some]
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(cosine[i, k]), pa.array(ids[k])], names=["i", "cosine", "clusterId"])

        near = self.table.mapInArrow(run, "i int, cosine double, clusterId bigint")
        best = near.groupBy("i").agg(F.slice(F.sort_array(F.collect_list(F.struct("cosine", "clusterId")), asc=False), 1, returned).alias("best"))
        found = {r["i"]: [(x["cosine"], x["clusterId"]) for x in r["best"]] for r in best.collect()}
        sent.unpersist()
        wanted = sorted({c for given in found.values() for _, c in given})
        if not wanted:
            return found, {}
        few = self.spark.createDataFrame(pa.table({"clusterId": pa.array(wanted, pa.int64())}))
        rows = self.table.join(F.broadcast(few), "clusterId").toArrow()  # at most ``returned`` clusters a vector
        return found, dict(zip(rows["clusterId"].to_pylist(), matrix(rows["total"], dim), strict=True))


def seeded(ordered: DataFrame, rows: int, dim: int, threshold: float, ws: Workspace, block: int = SEED_BLOCK, returned: int = RETURNED) -> tuple[DataFrame, DataFrame, int]:
    """Greedy clusters of ``ordered`` (``position`` 0 .. rows - 1, ``faceId``, ``embedding`` of ``dim`` numbers). Returns
    ``faceId, seeded``, ``clusterId, total`` (sums of the members) and the number of clusters."""
    spark = ordered.sparkSession
    centers, parts, kept = Centers(spark, dim, ws), [], []
    at = 0
    while at < rows:
        table = ordered.where(F.col("position").between(at, at + block - 1)).orderBy("position").select("faceId", "embedding").toArrow()
        vectors = matrix(table["embedding"], dim)
        answers, totals = centers.answers(vectors, threshold, returned)
        of = settle_block(vectors, centers.hot, answers, totals, threshold, centers.n, returned)
        centers.n = max(centers.n, max(of) + 1)
        kept.append((np.asarray(table["faceId"])[: len(of)], np.array(of, np.int64)))
        at += len(of)
        if centers.hot.n > block:
            centers.flush()
        if at >= rows or sum(len(x) for x, _ in kept) >= WRITTEN:
            ids, of_all = (np.concatenate(x) for x in zip(*kept, strict=True))
            parts.append(ws.save(spark.createDataFrame(pa.table({"faceId": pa.array(ids, pa.int64()), "seeded": pa.array(of_all)})), "seeded"))
            kept = []
    if not rows:
        return spark.createDataFrame([], "faceId bigint, seeded bigint"), spark.createDataFrame([], _CENTERS), 0
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every, centers.flush() if centers.hot.n else centers.table, centers.n


def merged(totals: np.ndarray, bar: float) -> np.ndarray:
    """The cluster that each one goes into: in order, every later cluster at ``bar`` or more joins, and moves the centroid
    that the clusters after it are compared with."""
    into, sums, cents = np.arange(len(totals)), totals.copy(), unit(totals)
    live = np.ones(len(totals), bool)
    for a in range(len(totals)):
        b = a
        while live[a]:
            near = np.flatnonzero(live[b + 1 :] & (cents[b + 1 :] @ cents[a] >= bar))
            if not len(near):
                break
            b += 1 + int(near[0])
            sums[a] += sums[b]
            cents[a] = unit(sums[a])
            live[b], into[b] = False, a
    return into
