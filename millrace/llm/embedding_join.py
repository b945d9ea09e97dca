"""Embedding near-dedup (operator 1): epsilon grid order join.

Unit vectors are rotated onto their principal dimensions, ordered by grid cells of side epsilon on the leading ones, and
cut into sequence intervals. Pairs of intervals are refined level by level, and a pair whose bounding boxes are further
apart than epsilon is skipped with all that it holds; the same recursion goes on inside a pair of blocks. A box spans the
leading dimensions and the length of what lies beyond them, which bounds the distance as well. Surviving blocks are
compared by a matrix product, and every cosine near the threshold is decided in double precision. The pairs are dealt out
in tiles of up to TILE by TILE blocks, so a block travels once for each tile and not once for each pair.

Exactly equal vectors are joined once and counted by multiplicity. A task returns counts and a spanning forest, never
its pairs, so large groups of near copies stay linear in size.

Edge cases: null, empty and zero vectors and those with null or non-finite components link with nothing and are their
own component; vectors of different lengths do not link; repeated rows are vectors of their own; an empty table gives an
empty result; only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from millrace.operators.components import connected_components
from millrace.storage import Workspace, scratch

#: Link from this cosine on.
THRESHOLD = 0.95
#: Vectors that fit the rotation at most (it only orders and prunes), grid dimensions, dimensions of a bounding box (one
#: more holds the length of the rest).
FIT_VECTORS, GRID_DIMS, BOX_DIMS = 4096, 8, 32
#: Bytes of vectors in a block, children of an interval, rows of the smallest interval inside a block, blocks on either
#: side of a tile at most.
BLOCK_BYTES, FAN_OUT, LEAF, TILE = 1 << 20, 8, 512, 16
#: Single-precision cosines this near the threshold are computed again in double precision: at least, and by dimension.
DOUBT, DOUBT_BY_DIM = 2e-5, 2.5e-7


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, key, dim, v`` with v the bytes of the vector and nulls where it can't link."""
    kind = np.float32 if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else np.float64
    id_type = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at = np.asarray(lists.offsets).astype(np.int64)
            x = lists.values.to_numpy(zero_copy_only=False).astype(kind, copy=False) + kind(0)  # nulls are not finite, -0 is 0
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            some = np.concatenate([[0], np.cumsum(x != 0)])
            good = (odd[at[1:]] == odd[at[:-1]]) & (some[at[1:]] > some[at[:-1]]) & np.asarray(lists.is_valid())
            bits = pa.py_buffer(np.packbits(good, bitorder="little").tobytes())
            ends = pa.py_buffer((at * x.itemsize).astype(np.int64).tobytes())
            raw = pa.Array.from_buffers(pa.large_binary(), len(good), [bits, ends, pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), raw.cast(pa.binary())], names=["id", "v"])

    made = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, f"id {id_type}, v binary")
    return made.select("id", F.when(F.col("v").isNotNull(), F.unhex(F.sha2("v", 256))).alias("key"), "v")


def _rotation(reps: DataFrame, kind: type) -> dict[int, np.ndarray]:
    """Principal axes by vector length, from a bounded sample in hash order."""
    sample = [np.frombuffer(r.v, kind) for r in reps.orderBy(F.xxhash64("key")).limit(FIT_VECTORS).select("v").collect()]
    axes = {}
    for d in {len(x) for x in sample}:
        x = _unit(np.array([s for s in sample if len(s) == d]))
        axes[d] = np.linalg.eigh(np.cov(x.T).reshape(d, d) if len(x) > 1 else np.eye(d))[1][:, ::-1][:, :BOX_DIMS].copy()
    return axes


def _axes(axes: dict[int, np.ndarray], d: int) -> np.ndarray:
    return axes[d] if d in axes else np.eye(d)[:, :BOX_DIMS]


def _coordinates(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Box coordinates of unit vectors: along the axes, padded by zeros, and the length of what lies beyond them."""
    z = unit @ axes
    out = np.zeros((len(unit), BOX_DIMS + 1))
    out[:, : z.shape[1]] = z
    out[:, BOX_DIMS] = np.sqrt(np.maximum(0.0, 1.0 - (z * z).sum(1)))
    return out


def _grid(reps: DataFrame, axes: dict[int, np.ndarray], kind: type, epsilon: float) -> DataFrame:
    """Adds the length, the grid cell and the position on the first axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            dims = np.array([len(x) // np.dtype(kind).itemsize for x in raw], np.int32)
            cells, first = [None] * len(raw), np.zeros(len(raw))
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                y = _unit(np.array([np.frombuffer(raw[k], kind) for k in rows])) @ _axes(axes, int(d))
                first[rows] = y[:, 0]
                for k, c in zip(rows.tolist(), np.floor(y[:, :GRID_DIMS] / epsilon).astype(np.int32).tolist(), strict=True):
                    cells[k] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(cells, pa.list_(pa.int32())), pa.array(first)], names=["key", "copies", "v", "dim", "cell", "first"])

    return reps.select("key", "copies", "v").mapInArrow(run, "key binary, copies bigint, v binary, dim int, cell array<int>, first double")


def _number(ordered: DataFrame, ws: Workspace) -> DataFrame:
    """Global position ``pos`` of rows that were written in order of (file partition, row)."""
    seen = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = seen.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return ordered.join(ws.save(before, "bases"), "part").withColumn("pos", F.col("base") + F.col("row")).drop("part", "row", "base")


def _blocks(numbered: DataFrame, axes: dict[int, np.ndarray], kind: type, rows_per_block: int) -> DataFrame:
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        dims, raw = np.asarray(table["dim"]), table["v"].to_pylist()
        y = np.zeros((len(raw), BOX_DIMS + 1))
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            y[rows] = _coordinates(_unit(np.array([np.frombuffer(raw[k], kind) for k in rows])), _axes(axes, int(d)))
        cols = {
            "block": pa.array([table["block"][0].as_py()]), "pos": pa.array([np.asarray(table["pos"]).tobytes()]), "copies": pa.array([np.asarray(table["copies"]).tobytes()]),
            "dims": pa.array([dims.astype(np.int32).tobytes()]), "v": pa.array([b"".join(raw)]),
            "lo": pa.array([y.min(0).tolist()]), "hi": pa.array([y.max(0).tolist()]),
        }
        return pa.table(cols)

    keyed = numbered.select(F.floor(F.col("pos") / rows_per_block).cast("bigint").alias("block"), "pos", "copies", "dim", "v")
    return keyed.groupBy("block").applyInArrow(build, "block bigint, pos binary, copies binary, dims binary, v binary, lo array<double>, hi array<double>")


def _near(epsilon: float):
    """Squared distance of two boxes, within epsilon squared (and a little more for rounding)."""
    gap = F.zip_with(
        F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y),
        lambda x, y: F.pow(F.greatest(x, y, F.lit(0.0)), 2),
    )
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) <= epsilon * epsilon + 1e-6


def interval_pairs(boxes: DataFrame, n_blocks: int, epsilon: float, ws: Workspace) -> DataFrame:
    """Pairs a <= b of blocks that may hold a link. From one interval over all blocks, each level replaces a pair of
    intervals by the pairs of their children and drops those whose boxes are too far apart."""
    levels = 0
    while FAN_OUT**levels < n_blocks:
        levels += 1
    pairs = boxes.sparkSession.createDataFrame([(0, 0)], "a bigint, b bigint")
    children = F.sequence(F.lit(0), F.lit(FAN_OUT - 1))
    for level in range(levels - 1, -1, -1):
        width = FAN_OUT**level
        dims = range(BOX_DIMS + 1)
        box = boxes.groupBy(F.floor(F.col("block") / width).cast("bigint").alias("of")).agg(
            F.array(*[F.min(F.col("lo")[k]) for k in dims]).alias("lo"), F.array(*[F.max(F.col("hi")[k]) for k in dims]).alias("hi")
        )
        box = ws.save(box, f"boxes{level}")
        a, b = (box.select(F.col("of").alias(x), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}")) for x in "ab")
        split = pairs.withColumn("i", F.explode(children)).withColumn("j", F.explode(children))
        split = split.select((F.col("a") * FAN_OUT + F.col("i")).alias("a"), (F.col("b") * FAN_OUT + F.col("j")).alias("b")).where("a <= b")
        pairs = ws.save(split.join(a, "a").join(b, "b").where(_near(epsilon)).select("a", "b"), f"pairs{level}")
    return pairs


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, smallest node) of each component of a two-sided link matrix."""
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    linked, left, right = linked[np.ix_(rows, cols)], left[rows], right[cols]
    by_col = np.ascontiguousarray(linked.T)
    open_rows, open_cols, edges = np.ones(len(rows), bool), np.ones(len(cols), bool), []
    for start in range(len(rows)):
        if not open_rows[start]:
            continue
        front, nodes = np.array([start]), [left[start : start + 1]]
        open_rows[start] = False
        while len(front):
            reached = np.flatnonzero(linked[front].any(0) & open_cols)
            open_cols[reached] = False
            nodes.append(right[reached])
            front = np.flatnonzero(by_col[reached].any(0) & open_rows) if len(reached) else reached
            open_rows[front] = False
            nodes.append(left[front])
        every = np.unique(np.concatenate(nodes))
        edges += [(x, int(every[0])) for x in every[1:].tolist()]
    return edges


def compare_blocks(a: dict, b: dict, same: bool, threshold: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Links of two blocks: for each position the number of vectors linked on the other side, and a spanning forest."""
    epsilon = np.sqrt(2 - 2 * threshold) + 1e-4
    counts: dict[int, int] = {}
    edges: list[tuple[int, int]] = []
    for d in np.intersect1d(a["dims"], b["dims"]).tolist():
        pick = [np.flatnonzero(x["dims"] == d) for x in (a, b)]
        unit, single, y = ([x[of][d] for x in (a, b)] for of in ("unit", "single", "y"))
        doubt = max(DOUBT, DOUBT_BY_DIM * d)
        pos = [x["pos"][k] for x, k in zip((a, b), pick, strict=True)]
        copies = [x["copies"][k].astype(np.float64) for x, k in zip((a, b), pick, strict=True)]
        linked = np.zeros((len(unit[0]), len(unit[1])), bool)
        todo = [(0, len(unit[0]), 0, len(unit[1]))]
        while todo:
            i, j, k, m = todo.pop()
            if same and m <= i:
                continue  # the mirror image is done elsewhere
            ya, yb = y[0][i:j], y[1][k:m]
            gap = np.maximum(0, np.maximum(ya.min(0) - yb.max(0), yb.min(0) - ya.max(0)))
            if float((gap * gap).sum()) > epsilon * epsilon:
                continue
            if max(j - i, m - k) > LEAF:
                halves_a = [(i, j)] if j - i <= LEAF else [(i, (i + j) // 2), ((i + j) // 2, j)]
                halves_b = [(k, m)] if m - k <= LEAF else [(k, (k + m) // 2), ((k + m) // 2, m)]
                todo += [(*p, *q) for p in halves_a for q in halves_b]
                continue
            cosine = single[0][i:j] @ single[1][k:m].T
            hit = cosine >= threshold
            r, c = np.nonzero(np.abs(cosine - np.float32(threshold)) < doubt)
            if len(r):
                hit[r, c] = np.einsum("ij,ij->i", unit[0][i:j][r], unit[1][k:m][c]) >= threshold
            linked[i:j, k:m] = hit
        if same:
            linked |= linked.T
            np.fill_diagonal(linked, False)
        if not linked.any():
            continue
        for side, view, other in ((0, linked, 1), (1, linked.T, 0)):
            if same and side:
                break
            for k in np.flatnonzero(view.any(1)).tolist():
                counts[int(pos[side][k])] = counts.get(int(pos[side][k]), 0) + int(copies[other][view[k]].sum())
        edges += _forest(linked, pos[0], pos[1])
    return counts, edges


def _block(row: dict, axes: dict[int, np.ndarray], kind: type) -> dict:
    """A block ready to be compared: by dimension its unit vectors in both precisions and their box coordinates."""
    dims = np.frombuffer(row["dims"], np.int32)
    values, unit = np.frombuffer(row["v"], kind), {}
    starts = np.concatenate([[0], np.cumsum(dims)[:-1]]) if len(dims) else dims
    for d in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == d)
        unit[d] = _unit(values.reshape(-1, d) if len(rows) == len(dims) else np.array([values[starts[k] : starts[k] + d] for k in rows]))
    return {
        "dims": dims, "unit": unit, "single": {d: u.astype(np.float32) for d, u in unit.items()}, "y": {d: _coordinates(u, _axes(axes, d)) for d, u in unit.items()},
        "pos": np.frombuffer(row["pos"], np.int64), "copies": np.frombuffer(row["copies"], np.int64),
    }


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES, workspace: Workspace | None = None) -> DataFrame:
    """``id, n_links, component_id, kept`` for every vector; see the module for the method and its edge cases."""
    ws = scratch(vectors.sparkSession, "embedding-join", workspace)
    kind = np.float32 if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else np.float64
    epsilon = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    valid = ws.save(_valid(vectors, id_col, vec_col), "valid")
    reps = valid.where("key is not null").groupBy("key").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    reps = ws.save(reps, "representatives")
    size = reps.agg(F.count("*").alias("n"), F.max(F.length("v")).alias("bytes")).first()
    found = None
    if size.n:
        axes = _rotation(reps, kind)
        per_block = max(64, block_bytes // size.bytes)
        parts = max(1, min(10_000, -(-size.n // per_block)))
        ordered = _grid(reps, axes, kind, epsilon).repartitionByRange(parts, "dim", "cell", "first", "key").sortWithinPartitions("dim", "cell", "first", "key")
        mark = F.monotonically_increasing_id()
        ordered = ws.save(ordered.withColumn("mark", mark).select("key", "copies", "v", "dim", F.shiftright("mark", 33).alias("part"), F.col("mark").bitwiseAND((1 << 33) - 1).alias("row")), "ordered")
        numbered = ws.save(_number(ordered, ws), "numbered")
        blocks = ws.save(_blocks(numbered, axes, kind, per_block), "blocks")
        n_blocks = -(-size.n // per_block)
        pairs = interval_pairs(blocks.select("block", "lo", "hi"), n_blocks, epsilon, ws)
        width = tile_width(n_blocks, vectors.sparkSession.sparkContext.defaultParallelism)
        found = ws.save(_compare(pairs, blocks, width, axes, threshold, kind), "found")
    return _labelled(valid, reps, numbered if found is not None else None, found, id_col, ws)


def tile_width(n_blocks: int, tasks: int) -> int:
    """Blocks on a side of a tile: as many as leave each task about two tiles, up to TILE."""
    return max(1, min(TILE, int(n_blocks / np.sqrt(4 * max(1, tasks)))))


def _compare(pairs: DataFrame, blocks: DataFrame, width: int, axes: dict[int, np.ndarray], threshold: float, kind: type) -> DataFrame:
    """All blocks that a tile's pairs need meet in a task; rows come back as (node, links, root). The pairs of a tile, at
    most TILE squared, travel with each of its blocks."""
    tile = lambda c: F.floor(F.col(c) / width)
    tiles = pairs.groupBy(tile("a").alias("ta"), tile("b").alias("tb")).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("todo"))
    needed = F.array_distinct(F.flatten(F.transform("todo", lambda p: F.array(p["a"], p["b"]))))
    sent = tiles.select("ta", "tb", "todo", F.explode(needed).alias("block")).join(blocks.select("block", "pos", "copies", "dims", "v"), "block")

    def meet(table: pa.Table) -> pa.Table:
        todo = table["todo"][0].as_py()
        raw = {r["block"]: r for r in table.drop_columns(["todo"]).to_pylist()}
        ready: dict[int, dict] = {}
        node, links, root = [], [], []
        for k, pair in enumerate(todo):
            for x in (pair["a"], pair["b"]):
                if x not in ready:
                    ready[x] = _block(raw[x], axes, kind)
            counts, edges = compare_blocks(ready[pair["a"]], ready[pair["b"]], pair["a"] == pair["b"], threshold)
            node += [*counts, *[x for x, _ in edges]]
            links += [*counts.values(), *[0] * len(edges)]
            root += [*[None] * len(counts), *[x for _, x in edges]]
            if k + 1 < len(todo) and todo[k + 1]["a"] != pair["a"]:
                ready.pop(pair["a"], None)  # pairs come in order of a
        return pa.table({"node": pa.array(node, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(root, pa.int64())})

    return sent.groupBy("ta", "tb").applyInArrow(meet, "node bigint, links bigint, root bigint")


def _labelled(valid: DataFrame, reps: DataFrame, numbered: DataFrame | None, found: DataFrame | None, id_col: str, ws: Workspace) -> DataFrame:
    own = F.col("id")
    if found is None:
        return valid.select(own.alias(id_col), F.lit(0).cast("bigint").alias("n_links"), own.alias("component_id"), F.lit(True).alias("kept"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("root is not null"), "node", "root", ws)
    # every representative that links, with the least id of its component
    nodes = numbered.select("key", F.col("pos").alias("node")).join(reps.select("key", "least_id", "copies"), "key")
    nodes = ws.save(nodes.join(components, "node", "left").join(links, "node", "left").select("key", "least_id", "copies", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "nodes")
    least = ws.save(nodes.groupBy("component").agg(F.min("least_id").alias("component_id")), "least")
    answers = ws.save(nodes.join(least, "component").select(F.col("key").alias("of"), (F.col("links") + F.col("copies") - 1).alias("links"), "component_id"), "answers")
    ws.keep(valid, answers)
    joined = valid.select("id", "key").join(answers, F.col("key") == F.col("of"), "left")
    label = F.coalesce("component_id", own)
    return joined.select(own.alias(id_col), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), label.alias("component_id"), F.coalesce(own == label, F.lit(True)).alias("kept"))


def op1(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
