"""Clustering against a plain statement of it, for blocks of any size; pins, votes and parking."""

import numpy as np
import pytest

from millrace import config as C, schemas
from millrace.operators import people as P, seeding as G

FACES = schemas.FACES.replace("quality float", "quality double")


def frame(spark, rows):
    return spark.createDataFrame([(r["id"], r["id"], 0, 0, 9, 9, r["q"], r["v"], 1, r["c"], r["p"], r["pin"]) for r in rows], FACES)


def face(id, v, q=0.9, c=-1, p=0, pin=False):
    return {"id": id, "q": q, "v": None if v is None else [float(x) for x in v], "c": c, "p": p, "pin": pin}


def plain(rows, threshold, cap=C.MERGE_CAP):
    """Face by face: seed, merge, renumber, settle, pins, votes, parking."""
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) >= 1e-8 else v
    usable = sorted((r for r in rows if r["v"] is not None and r["q"] is not None and r["q"] >= C.FACE_QUALITY), key=lambda r: (-r["q"], r["id"]))
    good = [r for r in usable if len(r["v"]) == len(usable[0]["v"])]
    sums, of = [], {r["id"]: -1 for r in usable}
    for r in good:
        v = np.array(r["v"])
        scores = [unit(s) @ v for s in sums]
        best = max(range(len(sums)), key=lambda k: (scores[k], k), default=None)
        if best is None or scores[best] < threshold:
            sums.append(np.zeros(len(v)))
            best = len(sums) - 1
        sums[best] = sums[best] + v
        of[r["id"]] = best
    gone = set()
    if cap is None or len(sums) <= cap:
        for a in range(len(sums)):
            for b in range(a + 1, len(sums)):
                if a not in gone and b not in gone and unit(sums[a]) @ unit(sums[b]) >= min(threshold + 0.04, 0.97):
                    sums[a] = sums[a] + sums[b]
                    gone.add(b)
                    of = {k: a if c == b else c for k, c in of.items()}
    new = {}
    for r in good:
        new.setdefault(of[r["id"]], len(new))
    of = {k: new.get(c, -1) for k, c in of.items()}
    centres = [unit(sum(np.array(r["v"]) for r in good if of[r["id"]] == k)) for k in range(len(new))]
    for r in good:
        scores = [c @ np.array(r["v"]) for c in centres]
        best = max(range(len(centres)), key=lambda k: (scores[k], k))
        if scores[best] >= threshold:
            of[r["id"]] = best
    return plain_people(rows, {r["id"] for r in usable}, of)


def plain_people(rows, used, of):
    """Pins, votes and parking, given the cluster of each used face."""
    of, usable = dict(of), [r for r in rows if r["id"] in used]
    most = lambda xs: max(set(xs), key=lambda x: (xs.count(x), -x))
    fresh, forced = max(of.values(), default=-1) + 1, {}
    before = dict(of)
    for person in sorted({r["p"] for r in usable if r["pin"] and r["p"] > 0}):
        homes = [before[r["id"]] for r in usable if r["p"] == person and not r["pin"] and before[r["id"]] >= 0]
        home = most(homes) if homes else fresh
        fresh += not homes
        forced[home] = person
        of |= {r["id"]: home for r in usable if r["pin"] and r["p"] == person}
    name = {c: most([r["p"] for r in usable if of[r["id"]] == c and r["p"] > 0]) for c in {of[r["id"]] for r in usable if r["p"] > 0 and of[r["id"]] >= 0}} | forced
    out = {r["id"]: (of[r["id"]], name.get(of[r["id"]], 0)) for r in usable}
    return out | {r["id"]: (r["c"], r["p"]) if r["pin"] else (-1, 0) for r in rows if r["id"] not in used}


def some_rows(seed, n=90, centres=7, dim=12, odd=True):
    rng = np.random.default_rng(seed)
    base, rows = rng.normal(size=(centres, dim)), []
    for k in range(n):
        v = base[k % centres] + rng.normal(size=dim) * rng.choice([0.2, 0.6])
        v = (v / np.linalg.norm(v)).astype(np.float32).astype(float).tolist()
        v = None if odd and k == 11 else [1.0, 0.0] if odd and k in (12, 13, 14, 15) else v
        rows.append(face(k, v, None if odd and k == 20 else round(float(rng.uniform(0.1, 1)), 1), k % 3, int(rng.integers(0, 4)), bool(rng.random() < 0.15) or k == 13))
    return rows


def got(spark, rows, threshold, *args, **kw):
    return {r.faceId: (r.clusterId, r.personId) for r in P.cluster(frame(spark, rows), threshold, *args, **kw).collect()}


@pytest.mark.parametrize("seed, threshold, block", [(1, 0.62, 4096), (2, 0.8, 20)])
def test_clustering_equals_a_plain_statement_of_it(spark, seed, threshold, block):
    rows = some_rows(seed)
    assert got(spark, rows, threshold, block) == plain(rows, threshold)
    assert got(spark, rows, threshold, block, sent_bytes=0) == plain(rows, threshold)


@pytest.mark.parametrize("block, returned", [(3, 1), (9, 2), (40, 1), (1000, 4)])
def test_seeding_is_the_greedy_pass_for_any_block(spark, monkeypatch, block, returned):
    from millrace.storage import Workspace

    rng = np.random.default_rng(block)
    base = rng.normal(size=(9, 5))
    v = base[rng.integers(0, 9, 60)] + rng.normal(size=(60, 5)) * 0.5
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[50] = v[3]
    sums, want = [], []
    for x in v:
        cosine = [s / np.linalg.norm(s) @ x for s in sums]
        k = max(range(len(sums)), key=lambda c: (cosine[c], c), default=-1)
        if k < 0 or cosine[k] < 0.85:
            sums.append(np.zeros(5))
            k = len(sums) - 1
        sums[k] = sums[k] + x
        want.append(k)
    ordered = spark.createDataFrame([(k, 100 + k, x.tolist()) for k, x in enumerate(v)], "position bigint, faceId bigint, embedding array<double>")
    monkeypatch.setattr(G, "WRITTEN", 20)
    sizes, plain_block = [], G.settle_block
    monkeypatch.setattr(G, "settle_block", lambda *a: sizes.append((len(a[0]), a[1].n)) or plain_block(*a))
    start, centers, n = G.seeded(ordered, 60, 5, 0.85, Workspace(spark, "seeds"), block, returned)
    assert {r.faceId: r.seeded for r in start.collect()} == {100 + k: c for k, c in enumerate(want)} and start.count() == 60
    assert n == len(sums) and np.allclose([r.total for r in centers.orderBy("clusterId").collect()], sums)
    assert all(rows <= block and hot <= 2 * block for rows, hot in sizes)  # what the driver holds


def test_merging_moves_the_centroid():
    rng = np.random.default_rng(4)
    for bar in (0.5, 0.8, 0.95):
        totals = np.repeat(rng.normal(size=(12, 6)), 3, 0) + rng.normal(size=(36, 6)) * 0.4
        sums, into = totals.copy(), list(range(36))
        for a in range(36):
            for b in range(a + 1, 36):
                if into[a] == a and into[b] == b and G.unit(sums[a]) @ G.unit(sums[b]) >= bar:
                    sums[a] = sums[a] + sums[b]
                    into[b] = a
        assert G.merged(totals, bar).tolist() == into
    assert G.merged(np.zeros((0, 6)), 0.5).tolist() == []


@pytest.mark.parametrize("cap", [None, 3000, 3])
def test_more_clusters_than_the_cap_are_not_merged(spark, cap):
    rows = some_rows(6, 40, 20, 6, odd=False)
    assert got(spark, rows, 0.9, 8, merge_cap=cap) == plain(rows, 0.9, cap)


def test_a_pin_names_its_cluster(spark):
    e = np.eye(4)
    rows = [face(k, e[0], p=7) for k in (1, 2, 3)] + [face(4, e[0], p=5), face(5, e[1], p=5, pin=True)]
    assert got(spark, rows, 0.62) == {1: (0, 5), 2: (0, 5), 3: (0, 5), 4: (0, 5), 5: (0, 5)} == plain(rows, 0.62)


def test_pins_without_a_home_found_clusters_and_pinned_faces_of_low_quality_stay(spark):
    e = np.eye(4)
    rows = [face(1, e[0], p=0), face(2, e[0], p=9, pin=True), face(3, e[1], p=9, pin=True), face(4, e[1], p=8, pin=True), face(5, e[2], q=0.1, c=6, p=3, pin=True), face(6, e[2], q=0.1, c=6, p=3), face(7, None, c=2, p=1, pin=True), face(8, e[3], p=0, pin=True)]
    assert got(spark, rows, 0.62) == plain(rows, 0.62)
    assert plain(rows, 0.62) == {1: (0, 0), 2: (4, 9), 3: (4, 9), 4: (3, 8), 5: (6, 3), 6: (-1, 0), 7: (2, 1), 8: (2, 0)}
    shared = [face(k, e[0], p=p) for k, p in enumerate((4, 4, 6, 6, 6))] + [face(10, e[1], p=4, pin=True), face(11, e[2], p=6, pin=True)]
    assert got(spark, shared, 0.62) == plain(shared, 0.62) and set(plain(shared, 0.62).values()) == {(0, 6)}


def test_no_usable_faces(spark):
    rows = [face(1, [1, 0], q=0.1, c=4, p=2), face(2, None, c=4, p=2, pin=True)]
    assert got(spark, rows, 0.62) == {1: (-1, 0), 2: (4, 2)}
    assert P.cluster(frame(spark, rows).limit(0), 0.62).count() == 0


def test_folder_plan_of_very_many_small_clusters(spark):
    from millrace.functions.scalar import PERSON
    from millrace.plans import folders

    rng = np.random.default_rng(8)
    rows = [(c, c + 1, ("Ann", None, " ")[c % 3], int(p)) for c in range(1500) for p in rng.integers(0, 900, 1 + c % 4)]
    people = sorted({r[0] for r in rows}, key=lambda c: (-len({r[3] for r in rows if r[0] == c}), -sum(r[0] == c for r in rows), c))
    photos, seen, want, number = {c: [] for c in people}, set(), set(), 0
    for r in rows:
        photos[r[0]].append(r[3])
    for c in people:
        mine = {p for p in photos[c] if p not in seen}
        seen |= mine
        if len(mine) >= 2:
            number += c % 3 > 0
            want |= {(f"person-{c + 1}", "Ann" if c % 3 == 0 else f"{PERSON} {number}", c, p) for p in mine}
    got = folders.by_people(spark.createDataFrame(rows, "clusterId int, personId bigint, name string, photoId bigint"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
