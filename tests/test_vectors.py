"""Best matches against all products, and how many blocks meet."""

import numpy as np
import pytest

from millrace.operators.vectors import best_matches

SCHEMA = "id bigint, embedding array<double>"


def plain(queries, items, k, others, digits):
    out = set()
    for q, v in queries:
        scores = []
        for i, w in items:
            if v is not None and w is not None and len(v) == len(w) and not (others and i == q):
                s = float(np.dot(v, w))
                scores.append((-(round(s, digits) if digits is not None else s), i))
        out |= {(q, place, i, round(-s, 9)) for place, (s, i) in enumerate(sorted(scores)[:k])}
    return out


def clustered(rng, n, centres, dim, spread=0.05):
    base = rng.normal(size=(centres, dim)) * 3
    return base[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * spread


@pytest.mark.parametrize("k, others, digits, sent", [(1, False, None, 1 << 20), (3, True, 4, 1 << 20), (7, True, None, 1 << 20), (2, False, 1, 1 << 20), (3, True, 4, 0)])
def test_best_matches_equal_all_products(spark, k, others, digits, sent):
    rng = np.random.default_rng(k)
    v = np.round(clustered(rng, 90, 6, 5), 3)
    v[40:50] = v[3]  # ties
    rows = [(j, x.tolist()) for j, x in enumerate(v)] + [(200, None), (201, [1.0, 2.0]), (202, [2.0, 1.0]), (203, [])]
    odd = [(400, [float("nan")] * 5), (401, [1.0, None, 0.0, 0.0, 0.0])]  # match nothing
    queries = rows[::2] + [(300, [0.0] * 5), (301, [1.0] * 3)]
    df = spark.createDataFrame
    got = best_matches(df(queries + odd, SCHEMA), df(rows + odd, SCHEMA), k, "id", "id", others=others, digits=digits, block=8, sent_bytes=sent)
    rows_ = [(r.query, r.place, r.item, round(r.cosine, 9)) for r in got.collect()]
    want = {x for x in plain(queries, rows, k, others, digits) if x[0] != 203}
    assert {x for x in rows_ if x[0] != 203} == want and len(set(rows_)) == len(rows_)
    nothing = df([], SCHEMA)
    assert best_matches(nothing, df(rows, SCHEMA), k, "id", "id").count() == 0 == best_matches(df(rows, SCHEMA), nothing, k, "id", "id").count()


def test_far_blocks_do_not_meet(spark):
    rng = np.random.default_rng(4)
    v = clustered(rng, 1500, 30, 12)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(j, x.tolist()) for j, x in enumerate(v)], SCHEMA)
    report = {}
    got = best_matches(df, df, 2, "id", "id", others=True, block=32, report=report).collect()
    score = v @ v.T
    np.fill_diagonal(score, -2)
    assert {(r.query, r.place): round(r.cosine, 9) for r in got} == {(q, p): round(s, 9) for q in range(1500) for p, s in enumerate(sorted(score[q], reverse=True)[:2])}
    assert report["met"] * 4 < report["all"]
