"""Pairs of near 64-bit hashes by a multi-index search.

If two hashes differ in at most r bits, they agree in one of r + 1 parts. Rows are filed by the value of each part, so rows
that may be near meet in a task, and r + 1 rows are sent for each row however many there are. Within a task parts are not
enough: neighbouring parts form chunks, and a pair that differs in at most r bits also differs, in some chunk of k parts, in
fewer than k bits and in none of one of its parts. So a task files its rows by their chunk and looks each up under all
values that near; what is found is compared whole. The more rows there are, the longer the chunks, so a look-up finds few
rows by chance. A part's value that very many rows share is dealt out in tiles. Each pair is returned once, by the first
part that finds it.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.storage import Workspace

#: Rows of one value that a task compares at once, pairs that it holds, pairs that take as long to compare as one look-up
#: of all rows has besides.
TILE_ROWS, PAIRS, LOOKUP = 1 << 17, 1 << 20, 2000
HASHES = ("phash", "dhash")


@dataclass(frozen=True)
class Part:
    """``width`` bits from ``shift`` on of one hash, and the bits of the chunk around it, in which ``radius`` may differ."""

    side: int
    shift: int
    width: int
    chunk: int
    radius: int

    @property
    def mask(self) -> int:
        return (1 << self.width) - 1 << self.shift

    @property
    def others(self) -> int:
        return self.chunk & ~self.mask


@functools.lru_cache(maxsize=256)
def masks(bits: int, radius: int) -> np.ndarray:
    """All numbers with at most ``radius`` ones, at places that ``bits`` has ones in."""
    places = [1 << k for k in range(64) if bits >> k & 1]
    return np.array([sum(ones) for n in range(min(len(places), radius) + 1) for ones in combinations(places, n)], np.uint64)


def _values(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(min(width, radius) + 1))


def cover(side: int, radius: int, m: int) -> list[Part]:
    """The ``radius + 1`` parts of a hash, in ``m`` chunks."""
    n = radius + 1
    ends = [64 * k // n for k in range(n + 1)]
    out = []
    for c in range(m):
        own = range(n * c // m, n * (c + 1) // m)
        if own:
            chunk = (1 << ends[own[-1] + 1]) - (1 << ends[own[0]])
            out += [Part(side, ends[k], ends[k + 1] - ends[k], chunk, len(own) - 1) for k in own]
    return out


def cost(parts: list[Part], rows: int) -> float:
    """Look-ups of a row and what they find by chance."""
    return sum(_values(p.others.bit_count(), p.radius) * (1 + rows / 2 ** p.chunk.bit_count()) for p in parts)


def plan(limits: Sequence[tuple[int, int]], rows: int) -> list[Part]:
    """Parts for (side, greatest distance) of the hashes that are searched, in the chunks that cost least for so many rows."""
    return [p for side, r in limits for p in min((cover(side, r, m) for m in range(1, r + 2)), key=lambda parts: cost(parts, rows))]


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], raw: Sequence[str] = ()) -> Iterator[dict[str, np.ndarray]]:
    """Rows of each run of equal keys; rows come sorted by them. Columns in ``raw`` stay Arrow arrays."""

    def group(table: pa.Table) -> dict[str, np.ndarray]:
        return {c: table[c] if c in raw else np.asarray(table[c]) for c in table.column_names}

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        cols = {c: np.asarray(batch[c]) for c in keys}
        new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in cols.values()])) + 1
        if rest and any(rest[-1][c][-1].as_py() != batch[c][0].as_py() for c in keys):
            yield group(pa.Table.from_batches(rest))
            rest = []
        starts = [0, *map(int, new)]
        for lo, hi in zip(starts, starts[1:], strict=False):
            yield group(pa.Table.from_batches([*rest, batch.slice(lo, hi - lo)]))
            rest = []
        rest.append(batch.slice(starts[-1]))
    if rest:
        yield group(pa.Table.from_batches(rest))


def _found(filed: np.ndarray, asked: np.ndarray, part: Part) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``filed`` and ``asked`` of pairs that are near in the part's chunk, some at a time. All agree in the part.
    Where there are few rows for the number of look-ups, all pairs are made."""
    if len(filed) * len(asked) <= min(PAIRS, LOOKUP * _values(part.others.bit_count(), part.radius)):
        near = np.bitwise_count((filed[:, None] ^ asked[None, :]) & np.uint64(part.chunk)) <= part.radius
        yield np.nonzero(near)
        return
    others = np.uint64(part.others)
    order = np.argsort(filed & others, kind="stable")
    own, value = filed[order] & others, asked & others
    for m in masks(part.others, part.radius):
        near = value ^ m
        lo = np.searchsorted(own, near, "left")
        n = np.searchsorted(own, near, "right") - lo
        hit = np.flatnonzero(n)
        ends = np.cumsum(n[hit])
        at = 0
        while at < len(hit):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
            some = hit[at:to]
            counts = n[some]
            places = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo[some], counts)
            yield order[places], np.repeat(some, counts)
            at = to


def _any_zero_byte(x: np.ndarray) -> np.ndarray:
    ones, high = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
    return (x - ones & ~x & high) != 0


def filed(rows: DataFrame, parts: list[Part]) -> DataFrame:
    """``rows`` once for each part: ``part`` and ``value``."""
    value = lambda p: F.shiftrightunsigned(HASHES[p.side], p.shift).bitwiseAND(F.lit((1 << p.width) - 1 if p.width < 64 else -1))
    return rows.select("*", F.inline(F.array(*[F.struct(F.lit(k).alias("part"), value(p).alias("value")) for k, p in enumerate(parts)])))


def near_pairs(items: DataFrame, clauses: Sequence[tuple[int, int]], searched: Sequence[tuple[int, int]], ws: Workspace, shared_byte: bool = True, parts: list[Part] | None = None, tile_rows: int = TILE_ROWS, new: DataFrame | None = None) -> DataFrame:
    """``a, b, dp, dd``: pairs ``a < b`` of ``items`` (id, phash, dhash) that meet one of ``clauses`` (greatest distances of the
    two hashes) and, with ``shared_byte``, agree in a byte of either hash. ``searched`` are (side, greatest distance) of
    which every such pair meets one. Rows without a hash are left out; equal hashes meet like any others. With ``new`` (ids)
    only pairs with one of these, and only rows that agree with one in a part are sent."""
    rows = items.where("phash is not null and dhash is not null").select("id", *HASHES)
    if new is None:
        rows = ws.save(rows.withColumn("fresh", F.lit(True)), "hashes")
    else:
        rows = ws.save(rows.join(new.select(F.col("id").alias("_new")).distinct(), F.col("id") == F.col("_new"), "left").select("id", *HASHES, F.col("_new").isNotNull().alias("fresh")), "hashes")
    parts = plan(searched, rows.count()) if parts is None else parts
    sent = filed(rows, parts)
    if new is not None:
        sent = sent.join(sent.where("fresh").select("part", "value").distinct(), ["part", "value"], "left_semi")
    large = ws.save(sent.groupBy("part", "value").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles")).where("tiles > 1"), "large")
    if large.limit(1).count():
        tiles = F.coalesce("tiles", F.lit(1))
        dealt = sent.join(large, ["part", "value"], "left").withColumn("own", F.pmod(F.xxhash64("id"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        sent = dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    else:
        sent = sent.withColumns({c: F.lit(0) for c in ("x", "y", "own")})

    def earlier(x: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
        """Pairs that a part before the k-th finds."""
        out = np.zeros(len(x[0]), bool)
        for p in parts[:k]:
            out |= ((x[p.side] & np.uint64(p.mask)) == 0) & (np.bitwise_count(x[p.side] & np.uint64(p.chunk)) <= p.radius)
        return out

    def compared(k: int, hashes: list, ids: np.ndarray, others: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        differ = tuple(mine[i] ^ theirs[j] for mine, theirs in hashes)
        dp, dd = (np.bitwise_count(v) for v in differ)
        good = np.logical_or.reduce([(dp <= p) & (dd <= d) for p, d in clauses])
        if shared_byte:
            good &= _any_zero_byte(differ[0]) | _any_zero_byte(differ[1])
        good = np.flatnonzero(good)
        good = good[~earlier((differ[0][good], differ[1][good]), k)]
        if len(good):
            a, b = ids[i[good]], others[j[good]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(dp[good].astype(np.int32)), pa.array(dd[good].astype(np.int32))], names=["a", "b", "dp", "dd"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _grouped(batches, ["part", "value", "x", "y"]):
            k, x, y = (int(cell[c][0]) for c in ("part", "x", "y"))
            own, fresh = cell["own"], cell["fresh"]
            # rows that are filed and rows that are looked up; pairs of two fresh rows come from the first
            sides = [(own == x, (own == y) & fresh)] + ([((own == y) & ~fresh, (own == x) & fresh)] if x != y else [])
            for first, second in ((np.flatnonzero(a), np.flatnonzero(b)) for a, b in sides):
                hashes = [(v[first], v[second]) for v in (cell[h].view(np.uint64) for h in HASHES)]
                ids, others = cell["id"][first], cell["id"][second]
                for i, j in _found(*hashes[parts[k].side], parts[k]):
                    twice = fresh[first[i]] if x == y else np.zeros(len(i), bool)
                    some = np.flatnonzero(np.where(twice, ids[i] < others[j], ids[i] != others[j]))
                    yield from compared(k, hashes, ids, others, i[some], j[some])

    keys = ["part", "value", "x", "y"]
    return sent.select(*keys, "own", "fresh", "id", *HASHES).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint, dp int, dd int")
