"""Best matches between two tables of vectors, block by block, leaving out blocks that can't hold one."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.storage import Workspace, scratch

#: Vectors of a block, pivots that vectors are dealt out to, bytes of block centres that go along with every task.
BLOCK, PIVOTS, SENT_BYTES = 2048, 256, 64 << 20


def _pivots(items: DataFrame, n: int) -> dict[int, np.ndarray]:
    """By length, some of the vectors, chosen by hash."""
    rows = items.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x))).orderBy(F.xxhash64("id"), "id").limit(n).select("v").toArrow()["v"].to_pylist()
    return {d: np.array([v for v in rows if len(v) == d], float).reshape(-1, d) for d in {len(v) for v in rows}}


def _blocks(vectors: DataFrame, side: str, pivots: dict[int, np.ndarray], block: int, ws: Workspace) -> DataFrame:
    """One row per block: its vectors are of one length and nearest to one pivot. ``<side>``, ``dim``, ids and vectors as
    bytes, and the centre and the radius that hold them. A pivot of many vectors has several blocks. Vectors with a
    component that is null or not finite match nothing and are left out."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array([all(x is not None and math.isfinite(x) for x in v) for v in batch.column(1).to_pylist()], pa.bool_()))
            lists = batch.column(1).to_pylist()
            dims = np.array([len(v) for v in lists], np.int32)
            cell = np.zeros(len(lists), np.int32)
            for d in set(dims.tolist()) & set(pivots):
                at = np.flatnonzero(dims == d)
                v = np.array([lists[k] for k in at], float).reshape(len(at), d)
                cell[at] = np.argmin((pivots[d] ** 2).sum(1)[None, :] - 2 * v @ pivots[d].T, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims), pa.array(cell)], names=["id", "v", "dim", "cell"])

    def pack(table: pa.Table) -> pa.Table:
        ids = np.asarray(table["id"], np.int64)
        v = np.array(table["v"].to_pylist(), np.float64).reshape(len(ids), -1)
        centre = v.mean(0)
        radius = float(np.sqrt(((v - centre) ** 2).sum(1).max()))
        return pa.table({side: table["block"].slice(0, 1), "dim": table["dim"].slice(0, 1), f"{side}_ids": [ids.tobytes()], f"{side}_v": [v.tobytes()], "n": [len(ids)], "centre": [centre.tobytes()], "radius": [radius]})

    rows = ws.save(vectors.mapInArrow(cells, "id bigint, v array<double>, dim int, cell int"), f"{side}-cells")
    parts = rows.groupBy("cell", "dim").agg(F.ceil(F.count("*") / block).cast("bigint").alias("parts"))
    keyed = rows.join(parts, ["cell", "dim"]).withColumn("block", F.col("cell").cast("bigint") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("parts")))
    return ws.save(keyed.select("block", "dim", "id", "v").groupBy("block", "dim").applyInArrow(pack, f"{side} bigint, dim int, {side}_ids binary, {side}_v binary, n bigint, centre binary, radius double"), f"{side}-blocks")


def _summary(table: pa.Table) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: block numbers, sizes, centres, radii."""
    out = {}
    dims = np.asarray(table["dim"])
    for d in set(dims.tolist()):
        at = np.flatnonzero(dims == d)
        centre = np.frombuffer(b"".join(table["centre"][int(k)].as_py() for k in at)).reshape(len(at), d)
        out[d] = (np.asarray(table["i"])[at], np.asarray(table["n"])[at], centre, np.asarray(table["radius"])[at])
    return out


def _chosen(queries: DataFrame, sent, need: int, slack: float, first: bool) -> DataFrame:
    """``q, dim, i``: the item blocks that each query block meets. ``first``: those whose centres are best, until they hold
    ``need`` items. Else all others in which an item may reach ``bar``, the least k-th score that its queries have: no product
    of vectors within r and s of centres c and m is over c.m + |c| s + |m| r + r s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = sent.value
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["dim"] not in summary:
                    continue
                number, n, centre, radius = summary[r["dim"]]
                m = np.frombuffer(r["centre"])
                product = centre @ m
                order = np.argsort(-product, kind="stable")
                before = order[: int(np.searchsorted(np.cumsum(n[order]), need)) + 1]
                if first:
                    pick = before
                else:
                    bound = product + np.linalg.norm(centre, axis=1) * r["radius"] + np.linalg.norm(m) * radius + radius * r["radius"]
                    pick = np.setdiff1d(np.flatnonzero(bound + slack * (1 + abs(bound)) >= r["bar"]), before)
                out += [(r["q"], r["dim"], int(k)) for k in number[pick]]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["q", "dim", "i"])

    columns = ["q", "dim", "centre", "radius", *([] if first else ["bar"])]
    return queries.select(*columns).mapInArrow(run, "q bigint, dim int, i bigint")


def best_matches(queries: DataFrame, items: DataFrame, k: int, query_id: str, item_id: str, vec_col: str = "embedding", others: bool = False, digits: int | None = None, block: int = BLOCK, ws: Workspace | None = None, sent_bytes: int = SENT_BYTES, report: dict | None = None) -> DataFrame:
    """``query, place, item, cosine``: the k items of greatest dot product for each query, smaller ids first among equals.

    Vectors near each other lie in one block. A query block first meets the item blocks that look best; the k-th scores
    found there rule out item blocks that can't reach them, and only the rest travel. Each pair of blocks meets in a task of
    its own, which keeps k items for a query, so neither side is sent whole to a task. Block centres over ``sent_bytes`` are
    not sent; then all blocks meet. ``others`` leaves out the query's own id; ``digits`` rounds before comparing;
    ``report`` takes the numbers of block pairs that meet and that there are.
    """
    ws = scratch(queries.sparkSession, "matches", ws)
    sides = [df.where(F.col(vec_col).isNotNull()).select(F.col(c).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")) for df, c in ((queries, query_id), (items, item_id))]
    blocks = max(1, -(-sides[1].count() // block))
    pivots = _pivots(sides[1], min(PIVOTS, blocks))
    left, right = (_blocks(df, side, pivots, block, ws) for df, side in zip(sides, "qi", strict=True))

    def top_of(df: DataFrame, *keys) -> DataFrame:
        ranked = F.slice(F.sort_array(F.collect_list(F.struct("cosine", (-F.col("item")).alias("minus"))), asc=False), 1, k)
        return df.groupBy(*keys).agg(ranked.alias("top"))

    def meet(table: pa.Table) -> pa.Table:
        out = {"query": [], "item": [], "cosine": [], "i": [], "q": []}
        for r in table.to_pylist():
            a, b = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["i_ids"], np.int64)
            score = np.frombuffer(r["q_v"]).reshape(len(a), -1) @ np.frombuffer(r["i_v"]).reshape(len(b), -1).T
            if digits is not None:
                score = np.round(score, digits)
            if others:
                score[a[:, None] == b[None, :]] = -np.inf
            order = np.argsort(b, kind="stable")
            best = order[np.argsort(-score[:, order], axis=1, kind="stable")[:, :k]]
            top = np.take_along_axis(score, best, 1)
            live = np.isfinite(top)
            for name, x in (("query", np.broadcast_to(a[:, None], best.shape)), ("item", b[best]), ("cosine", top), ("i", np.full(best.shape, r["i"])), ("q", np.full(best.shape, r["q"]))):
                out[name].append(x[live])
        return pa.table({name: np.concatenate(x) for name, x in out.items()})

    def met(pairs: DataFrame) -> DataFrame:
        q, i = left.select("q", "dim", "q_ids", "q_v"), right.select("i", "dim", "i_ids", "i_v")
        return pairs.join(q, ["q", "dim"]).join(i, ["i", "dim"]).groupBy("q", "dim", "i").applyInArrow(meet, "query bigint, item bigint, cosine double, i bigint, q bigint")

    def top(found: DataFrame) -> DataFrame:
        """k of each query, those of some blocks at a time first."""
        some = top_of(found, "q", "query", F.pmod(F.xxhash64("i"), F.lit(64)).alias("part")).select("q", "query", F.explode("top").alias("s")).select("q", "query", "s.cosine", (-F.col("s.minus")).alias("item"))
        return top_of(some, "q", "query")

    flat = lambda df: df.select("q", "query", F.explode("top").alias("s")).select("q", "query", "s.cosine", (-F.col("s.minus")).alias("item"))
    everything = left.select("q", "dim").join(right.select("i", "dim"), "dim")
    size = right.agg(F.coalesce(F.sum(F.length("centre")), F.lit(0))).first()[0]
    if size > sent_bytes:
        final = top(met(everything))
    else:
        sent = queries.sparkSession.sparkContext.broadcast(_summary(right.select("i", "dim", "n", "centre", "radius").toArrow()))
        need, slack = k + others, 1e-9 if digits is None else 10.0**-digits
        first = ws.save(_chosen(left, sent, need, slack, True), "first")
        early = ws.save(top(met(first)), "early")
        least = early.groupBy("q").agg(F.min(F.when(F.size("top") >= k, F.col("top")[k - 1]["cosine"]).otherwise(F.lit(float("-inf")))).alias("bar"), F.count("*").alias("seen"))
        whole = left.join(least, "q", "left").withColumn("bar", F.when(F.col("seen") == F.col("n"), F.col("bar")).otherwise(F.lit(float("-inf"))))
        rest = ws.save(_chosen(whole, sent, need, slack, False), "rest")
        final = top_of(flat(early).unionByName(flat(top(met(rest)))), "q", "query")
        if report is not None:
            report |= {"met": first.count() + rest.count(), "all": everything.count()}
    return final.select("query", F.posexplode("top").alias("place", "s")).select("query", "place", (-F.col("s.minus")).alias("item"), F.col("s.cosine").alias("cosine"))
