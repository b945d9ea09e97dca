"""N-gram Jaccard join by set-relation skipping (operator 3).

Index level: every distinct set enters its prefix (rarest shingles first) into an index; sets are kept in blocks of one
family and one size class, and two blocks of a list are compared only if their sizes and the positions of the shared
shingle leave room for the needed overlap. Answer level: inside a pair of blocks, a set's overlaps with all sets on the
other side are derived from those of a highly similar set that is done already, by the shingles in which they differ.

Equal sets are joined once and counted by multiplicity. A task returns counts and a spanning forest, never its pairs.
Sets are told apart by 128 bits of hash: a set's number is the first half, and where two sets share one, the second half.
Shingles are told apart by 64-bit hashes. Blocks are compared by 40 of these bits first; pairs of sets so near the limit
that shingles alike in these bits could change their side (``slack``) meet again with all 64.

Edge cases: null, empty and blank texts have no shingle and link with nothing; a text of fewer words than a shingle is
one shingle; rows with a null id get their set size and no component; repeated rows are documents of their own, those
with equal ids share a component label; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.text import distinct, encoded, frugal, mix, slices, word_hashes
from millrace.operators.components import connected_components
from millrace.storage import Workspace, scratch

#: Buckets of the frequency sketch (of fixed size; it orders shingles and never decides a result), counters a shuffled
#: row holds, the least count and the deviations above the mean count that make a bucket frequent.
SKETCH_BITS, SKETCH_BLOCK, FREQUENT, DEVIATIONS = 24, 1 << 19, 16, 6
SKETCH, SKETCH_SHIFT = 1 << SKETCH_BITS, np.uint64(64 - SKETCH_BITS)
#: Rows of one list that a task gets at most, about; sets and shingles of a block; bits of the filter of wanted sets.
LIST_ROWS, BLOCK_SETS, BLOCK_SHINGLES, FILTER_BITS = 8192, 1024, 400_000, 1 << 24
#: Bytes of text that are cut into shingles at once.
SLICE = 1 << 18
#: Computed sets that later ones of a block may be derived from.
BASES = 6

#: Bits of a shingle that the first comparison leaves out.
SPARE = np.uint64(24)

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased. A word's hash is of its bytes alone."""
    words, n = word_hashes(texts)
    h = words.copy()
    for k in range(1, width):
        h = mix(h[:-1] * _STEP + words[k:]) if len(h) > 1 else h[:0]
    out, at = [], 0
    for count in n.tolist():
        if count >= width:
            out.append(distinct(h[at : at + count - width + 1]))
        elif count:
            x = words[at : at + 1]
            for k in range(1, count):
                x = mix(x * _STEP + words[at + k : at + k + 1])
            out.append(mix(x + np.uint64(count)))
        else:
            out.append(words[:0])
        at += count
    return out


def _halves(s: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _node(s: np.ndarray, shared: frozenset[int] = frozenset()) -> int:
    """Number of a set; ``shared`` holds the first halves that several sets have."""
    first, second = _halves(s)
    return second if first in shared else first


def _scan(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows (id, n, first and second half of the set's hash) of every document; and each task's sketch, in rows with a
    block number."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, id_type = np.zeros(SKETCH, np.int32), None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in slices(batch, limit=SLICE):
                sets = shingle_sets(encoded(part.column(1)), width)
                every = np.sort((np.concatenate(sets) >> SKETCH_SHIFT).astype(np.uint32)) if sets else np.zeros(0, np.uint32)
                starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else every[:0].astype(np.int64)
                sketch[every[starts]] += np.diff(np.append(starts, len(every))).astype(np.int32)
                n = len(sets)
                halves = [_halves(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), *[pa.array([h[k] for h in halves], pa.int64()) for k in (0, 1)], pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["id", "n", "first", "second", "block", "sums"])
        if id_type is not None:
            rows = sketch.reshape(-1, SKETCH_BLOCK)
            n = len(rows)
            packed = [zlib.compress(r.astype(np.uint16 if r.max() < 1 << 16 else np.int64).tobytes(), 1) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.nulls(n, id_type), *[pa.nulls(n, pa.int64())] * 3, pa.array(range(n), pa.int32()), pa.array(packed, pa.binary())], names=["id", "n", "first", "second", "block", "sums"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), f"id {kind}, n bigint, first bigint, second bigint, block int, sums binary")


def _numbered(scanned: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """``id, n, node`` and the first halves that unlike sets share. Their number is that of 64-bit collisions: under one
    is expected up to some 10**9 unlike sets, some hundreds at 10**11."""
    rows = scanned.where("block is null")
    alike = rows.where("first is not null").groupBy("first").agg(F.min("second").alias("low"), F.max("second").alias("high"))
    shared = frozenset(r["first"] for r in alike.where("low <> high").select("first").collect())
    node = F.when(F.col("first").isin(list(shared)), F.col("second")).otherwise(F.col("first")) if shared else F.col("first")
    return rows.select("id", "n", node.alias("node")), shared


def _frequent(scanned: DataFrame) -> np.ndarray:
    """The logarithm of the sketch's counts, in eighths, where they are frequent, else 0."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = zlib.decompress(raw)
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.uint16 if len(raw) == 2 * SKETCH_BLOCK else np.int64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["block", "sums"])

    total = np.zeros((SKETCH // SKETCH_BLOCK, SKETCH_BLOCK), np.float32)
    for k, raw in scanned.where("block is not null").select("block", "sums").repartition("block").mapInArrow(frugal(added), "block int, sums binary").collect():
        total[k] += np.frombuffer(zlib.decompress(raw), np.int64)
    total = total.ravel()
    mean = float(total.mean(dtype=np.float64))
    total[total <= max(FREQUENT, mean + DEVIATIONS * math.sqrt(mean))] = 1
    return np.minimum(8 * np.log2(total), 255).astype(np.uint8)


def _sublists(eighths: np.ndarray) -> np.ndarray:
    """Sub-lists that a list is dealt out to."""
    return 1 + (2.0 ** (eighths / 8.0) / LIST_ROWS).astype(np.int64)


def _new_sets(batch: pa.RecordBatch, width: int, seen: set[int], shared: frozenset[int]) -> Iterator[tuple[int, np.ndarray]]:
    for part in slices(batch, 0, SLICE):
        for s in shingle_sets(encoded(part.column(0)), width):
            if len(s) and (node := _node(s, shared)) not in seen:
                seen.add(node)
                yield node, s


def _entries(docs: DataFrame, text_col: str, width: int, percent: int, frequent, shared: frozenset[int]) -> DataFrame:
    """The index: prefix shingles of the sets, each set once per task. Lists of frequent shingles are dealt out to
    several sub-lists by a salt."""
    least = percent / (100 - percent)  # smaller sets link with equal ones only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = frequent.value, set()
        for batch in batches:
            token, salt, node, n, pos = [], [], [], [], []
            for k, s in _new_sets(batch, width, seen, shared):
                if len(s) < least:
                    continue
                order = counts[(s >> SKETCH_SHIFT).astype(np.int64)]
                p = len(s) - (-(-percent * len(s) // 100)) + 1
                first = np.lexsort((s, order))[:p] if order.any() else np.arange(p)
                token.append(s[first])
                salt.append(k % _sublists(order[first]))
                node.append(np.full(p, k, np.int64))
                n.append(np.full(p, len(s), np.int32))
                pos.append(np.arange(p, dtype=np.int32))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(salt).astype(np.int32)), pa.array(np.concatenate(node)), pa.array(np.concatenate(n)), pa.array(np.concatenate(pos))], names=["token", "salt", "node", "n", "pos"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(frugal(run), "token bigint, salt int, node bigint, n int, pos int")


def _lists(entries: DataFrame, frequent) -> DataFrame:
    """Entries of lists with two sets or more, each with the list's first set; whole sub-lists of salted lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rest = frequent.value, None
        for batch in _and_none(batches):
            if batch is not None:
                cols = [np.asarray(c) for c in batch.columns]
                cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            elif rest is not None:
                cols = rest
            else:
                break
            token, salt, node = cols[:3]
            if not len(token):
                continue
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])
            done = len(token)
            if batch is not None:  # the last list may go on
                done = int(np.flatnonzero(new)[-1])
                rest = [c[done:] for c in cols]
            keep = np.concatenate([[True], new[1:] | (node[1:] != node[:-1])])[:done]
            token, salt, node, n, pos = (c[:done][keep] for c in cols)
            starts = np.flatnonzero(new[:done][keep])
            length = np.diff(np.append(starts, len(token)))
            split = _sublists(counts[(token.view(np.uint64) >> SKETCH_SHIFT).astype(np.int64)]) > 1
            live = np.repeat(length > 1, length) | split
            leader = np.repeat(node[starts], length)
            yield pa.RecordBatch.from_arrays([pa.array(x[live]) for x in (token, node, n, pos, leader)], names=["token", "node", "n", "pos", "leader"])
            if batch is None:
                break

    dealt = entries.repartition("token", "salt").sortWithinPartitions("token", "salt", "node")
    return dealt.mapInArrow(frugal(run), "token bigint, node bigint, n int, pos int, leader bigint")


def _and_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _blocks_of(live: DataFrame, percent: int, ws: Workspace) -> DataFrame:
    """``node, n, of_block``: a set's family is the list leader that it meets most often. A small family is one block; of
    a large one, the sets of a size class are dealt out to blocks of bounded size."""
    met = live.groupBy("node", "leader").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(percent / 100))).cast("int")
    nodes = met.groupBy("node").agg(F.max_by("leader", F.struct("c", "leader")).alias("family"), F.max("n").alias("n")).withColumn("size_class", size_class)
    nodes = ws.save(nodes, "nodes")
    blocks = lambda count, total: F.greatest(F.ceil(count / BLOCK_SETS), F.ceil(total / BLOCK_SHINGLES)).cast("bigint")
    fill = ws.save(nodes.groupBy("family", "size_class").agg(F.count("*").alias("count"), F.sum("n").alias("total")), "fill")
    whole = fill.groupBy(F.col("family").alias("g")).agg(blocks(F.sum("count"), F.sum("total")).alias("all"))
    fill = ws.save(fill.join(whole, F.col("family") == F.col("g")).select(F.col("family").alias("f"), F.col("size_class").alias("s"), blocks(F.col("count"), F.col("total")).alias("k"), "all"), "deal")
    joined = nodes.join(fill, (F.col("family") == F.col("f")) & (F.col("size_class") == F.col("s")))
    own = F.when(F.col("all") == 1, F.xxhash64("family")).otherwise(F.xxhash64("family", "size_class", F.pmod("node", "k")))
    return joined.select("node", "n", own.alias("of_block"))


def _meetings(live: DataFrame, nodes: DataFrame, percent: int, ws: Workspace) -> DataFrame:
    """``node, pair, a, b``: the pairs a <= b of blocks in which a set has to be compared. Of every list, a block is a
    summary of its sets' sizes and of the room that the positions leave; a set skips the blocks whose summary can't
    reach the overlap that both sizes need."""
    placed = live.select("token", F.col("node").alias("m"), "pos").join(nodes, F.col("m") == F.col("node"))
    placed = ws.save(placed.select("token", "node", "n", (F.col("n") - F.col("pos")).alias("room"), "of_block"), "lists")
    blocks = placed.groupBy("token", "of_block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("room").alias("most_room"), F.count("*").alias("c"))
    blocks = ws.save(blocks.select(F.col("token").alias("t"), F.col("of_block").alias("other"), "least", "most", "most_room", "c"), "summaries")
    sizes = (100 * F.col("most") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("least"))
    need: Column = F.ceil(percent * (F.col("n") + F.col("least")) / (100 + percent))
    met = placed.join(blocks, (F.col("token") == F.col("t")) & ((F.col("of_block") != F.col("other")) | (F.col("c") > 1)) & sizes & (F.least("room", "most_room") >= need))
    a, b = F.least("of_block", "other"), F.greatest("of_block", "other")
    return met.select("node", F.xxhash64(a, b).alias("pair"), a.alias("a"), b.alias("b")).distinct()


def _filter(nodes: DataFrame) -> bytes:
    """A bitmap of fixed size that holds every wanted node."""
    bit = F.pmod("node", F.lit(FILTER_BITS)) + 1  # the bitmap functions count from 1
    parts = nodes.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = bytearray(FILTER_BITS // 8 + 8192)
    for k, bits in parts:
        out[(k - 1) * 4096 : (k - 1) * 4096 + len(bits)] = bits
    return bytes(out)


def _position(node: int) -> int:
    """Bit of a node as the bitmap functions number it: bucket 1 holds 0 .. 32767."""
    return node % FILTER_BITS


def _wanted_sets(docs: DataFrame, text_col: str, width: int, wanted, shared: frozenset[int], whole: bool = False) -> DataFrame:
    """``node, shingles`` (40 bits each, or all 64) of the sets in the filter, each once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, set()
        for batch in batches:
            nodes, values = [], []
            for k, s in _new_sets(batch, width, seen, shared):
                at = _position(k)
                if bits[at >> 3] >> (at & 7) & 1:
                    nodes.append(k)
                    values.append(s.tobytes() if whole else np.ascontiguousarray((s >> SPARE).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(values, pa.binary())], names=["m", "shingles"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(frugal(run), "m bigint, shingles binary")


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. A row is derived from the row of the computed set that it differs least from: shingles
    it has more add their lists, shingles it lacks take theirs away; without such a set it is summed afresh."""
    lt, rt = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(lt, rt)
    t = len(shared)
    out = np.zeros((len(left), len(right)), np.int32)
    if not t:
        return out
    lists = np.zeros((t, len(right)), np.uint8)
    where = np.searchsorted(shared, rt)
    hit = shared[np.minimum(where, t - 1)] == rt
    lists[where[hit], np.repeat(np.arange(len(right)), [len(x) for x in right])[hit]] = 1
    bases: list[tuple[np.ndarray, np.ndarray]] = []
    for k, s in enumerate(left):
        at = np.searchsorted(shared, s)
        own = np.zeros(t, bool)
        own[at[shared[np.minimum(at, t - 1)] == s]] = True
        size = int(own.sum())
        gaps = [int(np.count_nonzero(b != own)) for b, _ in bases]
        best = int(np.argmin(gaps)) if gaps else -1
        if best >= 0 and gaps[best] < size:
            base, row = bases[best]
            out[k] = row + lists[own & ~base].sum(0, dtype=np.int32) - lists[base & ~own].sum(0, dtype=np.int32)
        else:
            out[k] = lists[own].sum(0, dtype=np.int32)
        if best < 0 or gaps[best] > size // 4:
            bases = [*bases[-(BASES - 1) :], (own, out[k].copy())]
    return out


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each linked node to the least node of its component within this pair of blocks."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in np.flatnonzero(linked.any(1)).tolist():
        row = np.flatnonzero(linked[k])
        a = root(int(left[k]))
        for c in right[row].tolist():
            b = root(c)
            if a != b:
                a, b = min(a, b), max(a, b)
                parent[b] = a
    return [(x, root(x)) for x in list(parent) if root(x) != x]


def slack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shingles by which an overlap of 40 bits is taken to be off at most, by the sizes of both sets: more chance agreements,
    within or between the sets, have a probability under 2**-48. ``mean`` is the number expected."""
    mean = (a[:, None] + b[None, :]).astype(float) ** 2 / 2.0**41
    return np.ceil(48 / np.maximum(-np.log2(np.minimum(mean, 0.5)), 1)).astype(np.int64) - 1 + np.floor(4 * mean).astype(np.int64)


def _doubtful(a: dict, b: dict, inter: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose overlap of 40 bits lies within the slack of the limit."""
    both = a["n"][:, None] + b["n"][None, :]
    return np.abs((100 + percent) * inter.astype(np.int64) - percent * both) <= (100 + percent) * slack(a["n"], b["n"])


def compare_blocks(a: dict, b: dict, same: bool, percent: int, whole: bool = False) -> tuple[dict[int, int], list[tuple[int, int]], list[int]]:
    """Links of two blocks: per node the number of documents linked on the other side, and a spanning forest; and the nodes
    of doubtful pairs, which are left out. With ``whole`` sets have 64 bits a shingle, and the doubtful pairs alone count."""
    inter = overlaps([x >> SPARE for x in a["sets"]], [x >> SPARE for x in b["sets"]]) if whole else overlaps(a["sets"], b["sets"])
    doubt = _doubtful(a, b, inter, percent)
    if same:
        np.fill_diagonal(doubt, False)
    if whole:
        inter = overlaps(a["sets"], b["sets"])
    union = a["n"][:, None] + b["n"][None, :] - inter
    linked = (100 * inter >= percent * union) & (doubt if whole else ~doubt)
    again = [] if whole else [*a["node"][doubt.any(1)].tolist(), *([] if same else b["node"][doubt.any(0)].tolist())]
    if same:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return {}, [], again
    counts = dict(zip(a["node"].tolist(), (linked @ b["copies"]).tolist(), strict=True))
    if not same:
        counts |= dict(zip(b["node"].tolist(), (linked.T @ a["copies"]).tolist(), strict=True))
    return {k: v for k, v in counts.items() if v}, _forest(linked, a["node"], b["node"]), again


def _compare(sets: DataFrame, wanted: DataFrame, percent: int, whole: bool = False) -> DataFrame:
    """Both blocks of every pair meet; ``sets`` has m, shingles and ``wanted`` node, n, of_block, copies, pairs. A set goes
    to its pairs directly, so its shingles are dealt out twice: by set, and by pair. Rows hold a node's links, an edge to a
    root, or a pair of blocks in which the node has to be compared again."""
    sent = sets.join(wanted, F.col("m") == F.col("node")).select(F.explode("pairs").alias("p"), "of_block", "node", "n", "copies", "shingles")
    sent = sent.select("p.pair", "p.a", "p.b", "of_block", "node", "n", "copies", "shingles")

    unpack = (lambda raw: np.frombuffer(raw, np.uint64)) if whole else _unpack

    def meet(rows: list[dict]) -> tuple[dict[int, int], list[tuple[int, int]], list[int]]:
        a, b = rows[0]["a"], rows[0]["b"]
        sides = []
        for block in (a, b) if a != b else (a,):
            own = list({r["node"]: r for r in rows if r["of_block"] == block}.values())
            sides.append({"node": np.array([r["node"] for r in own], np.int64), "n": np.array([r["n"] for r in own], np.int64), "copies": np.array([r["copies"] for r in own], np.int64), "sets": [unpack(r["shingles"]) for r in own]})
        if not all(len(s["node"]) for s in sides):
            return {}, [], []
        return compare_blocks(sides[0], sides[-1], a == b, percent, whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in _and_none(batches):
            node, links, root, pair = [], [], [], []
            for r in batch.to_pylist() if batch is not None else [None]:
                if rows and (r is None or r["pair"] != rows[0]["pair"]):
                    counts, edges, again = meet(rows)
                    node += [*counts, *[x for x, _ in edges], *again]
                    links += [*counts.values(), *[0] * len(edges), *[0] * len(again)]
                    root += [*[None] * len(counts), *[x for _, x in edges], *[None] * len(again)]
                    pair += [*[None] * (len(counts) + len(edges)), *[rows[0]["pair"]] * len(again)]
                    rows = []
                if r is not None:
                    rows.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (node, links, root, pair)], names=["node", "links", "root", "again"])

    return sent.repartition("pair").sortWithinPartitions("pair").mapInArrow(frugal(run), "node bigint, links bigint, root bigint, again bigint")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85, workspace: Workspace | None = None) -> DataFrame:
    """``id, n_shingles, component_id, n_links`` per document: sets of ``width``-word shingles link from a Jaccard
    similarity of ``percent`` hundredths on. See the module for the method and its edge cases."""
    spark = docs.sparkSession
    ws = scratch(spark, "jaccard", workspace)
    scanned = ws.save(_scan(docs, id_col, text_col, width), "scan")
    rows, shared = _numbered(scanned)
    counts = spark.sparkContext.broadcast(_frequent(scanned))
    live = ws.save(_lists(_entries(docs, text_col, width, percent, counts, shared), counts), "live")
    reps = ws.save(rows.where("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("least_id"), F.count("*").alias("copies")), "representatives")
    nodes = ws.save(_blocks_of(live, percent, ws), "blocks")
    pairs = ws.save(_meetings(live, nodes, percent, ws), "meetings")
    pairs = pairs.groupBy(F.col("node").alias("of")).agg(F.collect_list(F.struct("pair", "a", "b")).alias("pairs"))
    wanted = nodes.join(reps, "node").join(pairs, F.col("node") == F.col("of"))
    wanted = ws.save(wanted.select("node", "n", "of_block", "copies", "pairs"), "wanted")
    sent = [counts, spark.sparkContext.broadcast(_filter(wanted))]
    sets = _wanted_sets(docs, text_col, width, sent[-1], shared)
    found = ws.save(_compare(sets, wanted, percent), "found")
    doubts = found.where("again is not null")
    if not doubts.isEmpty():
        doubts = doubts.groupBy("node").agg(F.collect_set("again").alias("which"))
        kept = F.filter("pairs", lambda p: F.array_contains("which", p["pair"]))
        unsure = ws.save(wanted.join(doubts, "node").select("node", "n", "of_block", "copies", kept.alias("pairs")), "unsure")
        sent.append(spark.sparkContext.broadcast(_filter(unsure)))
        sets = _wanted_sets(docs, text_col, width, sent[-1], shared, whole=True)
        found = found.where("again is null").unionByName(ws.save(_compare(sets, unsure, percent, whole=True), "decided"))
    for bits in sent:  # what follows reads saved tables; executors would hold these as long as the driver's garbage does
        bits.destroy()
    links = found.where("root is null").groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("root is not null"), "node", "root", ws)
    labelled = ws.save(reps.join(components, "node", "left").join(links, "node", "left").select("node", "least_id", "copies", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "labelled")
    least = ws.save(labelled.groupBy("component").agg(F.min("least_id").alias("component_id")), "least")
    answers = ws.save(labelled.join(least, "component").select(F.col("node").alias("of"), (F.col("links") + F.col("copies") - 1).alias("links"), "component_id"), "answers")
    ws.keep(scanned, answers)
    joined = rows.join(answers, F.col("node") == F.col("of"), "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"))


def op3(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
