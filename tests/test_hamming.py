"""The multi-index search against all pairs, at any size of chunks, regions and tiles; and how its rows grow."""

import random

import numpy as np
import pytest

from millrace import config as C
from millrace.operators import hamming as H, similar as N
from millrace.operators.components import connected_components
from millrace.storage import Workspace
from tests.test_catalogue import frame, photo, sig, signed

SCHEMA = "id bigint, phash bigint, dhash bigint"


def some_hashes(n, seed):
    """Hashes around a few centres at all distances, copies, and values that many share."""
    rng, out = random.Random(seed), []
    centres = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(6)] + [(0, 0), ((1 << 64) - 1, 1 << 63)]
    for k in range(n):
        p, d = rng.choice(centres)
        for _ in range(rng.randrange(0, 9)):
            p ^= 1 << rng.randrange(64)
        for _ in range(rng.randrange(0, 13)):
            d ^= 1 << rng.randrange(64)
        if k % 7 == 0:
            p = rng.getrandbits(16) << 48 | 0xABCDEF012345
        out.append((k * 3 - 50, signed(p), signed(d)))
    return out + [(10_000 + k, out[k][1], out[k][2]) for k in range(0, n, 9)]


def brute(rows, clauses, shared_byte=True):
    out = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0]:
                x, y = ((a[k] ^ b[k]) & (1 << 64) - 1 for k in (1, 2))
                dp, dd = x.bit_count(), y.bit_count()
                shares = not shared_byte or any(v >> 8 * k & 255 == 0 for v in (x, y) for k in range(8))
                if shares and any(dp <= p and dd <= d for p, d in clauses):
                    out.add((a[0], b[0], dp, dd))
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))  # each pair once
    return set(rows)


@pytest.mark.parametrize("m, tile, lookup, level", [(4, 1 << 16, 2000, C.LOOSE), (4, 17, 0, C.BALANCED), (5, 40, 0, C.LOOSE), (3, 1 << 16, 0, C.STRICT), (1, 5, 2000, C.STRICT)])
def test_no_pair_is_lost_and_none_comes_twice(spark, monkeypatch, m, tile, lookup, level):
    monkeypatch.setattr(H, "LOOKUP", lookup)
    rows = some_hashes(150, m * 100 + tile)
    items = spark.createDataFrame([*rows, (9, None, 1), (8, 1, None)], SCHEMA)
    parts = H.cover(0, level.p_max, m) + H.cover(1, level.d_strict, m)
    got = found(H.near_pairs(items, N.clauses(level), [(0, level.p_max), (1, level.d_strict)], Workspace(spark, "h"), parts=parts, tile_rows=tile))
    assert got == brute(rows, N.clauses(level))
    assert H.near_pairs(items.limit(0), N.clauses(level), [(0, 8)], Workspace(spark, "h"), parts=parts).count() == 0


@pytest.mark.parametrize("most", [0, 3, 7, 10])
def test_pairs_within_a_distance(spark, most):
    rows = some_hashes(120, most)
    assert found(N.near_in_hash(spark.createDataFrame(rows, SCHEMA), most, Workspace(spark, "h"))) == brute(rows, [(most, 64)])


def test_pairs_found_are_compared_some_at_a_time(monkeypatch):
    monkeypatch.setattr(H, "PAIRS", 7)
    monkeypatch.setattr(H, "LOOKUP", 0)
    rng = np.random.default_rng(1)
    filed, asked = rng.integers(0, 64, 60).astype(np.uint64), rng.integers(0, 64, 50).astype(np.uint64)
    part = H.Part(0, 6, 3, (1 << 9) - 1, 2)
    lots = list(H._found(filed, asked, part))
    assert sorted((int(i), int(j)) for x, y in lots for i, j in zip(x, y, strict=True)) == [(i, j) for i in range(60) for j in range(50) if int(filed[i] ^ asked[j]).bit_count() <= 2]
    assert max(len(x) for x, _ in lots) <= 7


def test_parts_find_every_difference():
    rng = random.Random(2)
    for radius in range(0, 20):
        for m in range(1, radius + 2):
            parts = H.cover(0, radius, m)
            assert len(parts) == radius + 1 and sum(p.mask for p in parts) == (1 << 64) - 1
            for _ in range(20):
                x = sum(1 << k for k in rng.sample(range(64), radius))
                assert any(x & p.mask == 0 and (x & p.chunk).bit_count() <= p.radius for p in parts)
    assert sorted(H.masks(0b1101, 1).tolist()) == [0, 1, 4, 8] and len(H.masks(0xFFFF, 2)) == 137


def test_rows_sent_grow_with_the_table(spark):
    """As many rows are filed for each row of a small table as of a large one; only the chunks get longer."""
    limits = [(0, C.BALANCED.p_max), (1, C.BALANCED.d_strict)]
    plans = [H.plan(limits, 10**k) for k in range(2, 11)]
    assert {len(p) for p in plans} == {9 + 7}
    widths = [max(p.chunk.bit_count() for p in parts) for parts in plans]
    assert widths == sorted(widths) and len(set(widths)) > 1
    # what a look-up finds by chance, and the look-ups, grow together by less than the table
    assert all(H.cost(b, 10 ** (k + 3)) < 10 * H.cost(a, 10 ** (k + 2)) for k, (a, b) in enumerate(zip(plans, plans[1:], strict=False)))
    rng = random.Random(3)
    for n in (100, 3000):
        rows = spark.createDataFrame([(k, signed(rng.getrandbits(64)), signed(rng.getrandbits(64))) for k in range(n)], SCHEMA)
        assert H.filed(rows, H.plan(limits, n)).count() == 16 * n


def test_components_through_representatives_of_copies(spark):
    rng = random.Random(5)
    base = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(5)]
    rows = []
    for k in range(90):
        p, d = base[k % 5]
        near = k % 3 and 1 << rng.randrange(64)
        rows.append(photo(k, phash=signed(p ^ near), dhash=signed(d), colorSig=sig(k % 5 + 3), size=2_000_000 + k))
    df = frame(spark, *rows)
    for level in (C.BALANCED,):
        every = connected_components(N.similar_pairs(df, level), "a", "b")
        want = {r.node: r.component for r in every.collect()}
        assert {r.id: r.component for r in N.similar_components(df, level).collect()} == want and want
    copies = frame(spark, *[photo(k, phash=5, dhash=6) for k in range(300)])
    edges = N.similar_edges(copies)
    assert edges.count() == 299 and {r.component for r in N.similar_components(copies).collect()} == {0}
