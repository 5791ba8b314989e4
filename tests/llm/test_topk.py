import random

import numpy as np
import pytest


def brute(rows, k, every):
    from fractions import Fraction
    from math import floor, isfinite

    ok = [(i, [floor(1024 * Fraction(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    near = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    out = []
    for q, v in ok:
        if q % every == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v)))[:k]
            out += [(q, n + 1, i, near(-s)) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("n", [0, 3, 700])
def test_exact(spark, n):
    from arcmesh.llm.topk import top_k

    r = random.Random(n)
    rows = [(i, [r.choice([-0.5, 0.0, 0.25, r.gauss(0, 1)]) for _ in range(6)]) for i in range(n)]
    if n > 10:
        rows += [(10**6, None), (10**6 + 100, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (10**6 + 200, [float("nan")] * 6), (10**6 + 300, [float("inf")] * 6), (None, [0.5] * 6), (900, []), (-100, [0.5] * 6)]
    clashing = spark.createDataFrame([(*x, 5, "d", 1.0) for x in rows], "vec_id long, embedding array<double>, rank int, d string, score double")
    got = sorted(tuple(x) for x in top_k(clashing, 10, 100, query_block=3, scans=2).collect())
    assert got == brute(rows, 10, 100)


def test_finite_components_of_any_size_take_part(spark):
    from arcmesh.llm.topk import top_k

    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(100, [9.1e15, -3.0, 0.5, 0.0]), (101, [1e300, 1e300, -1e300, 2.0]), (102, [1.7e308, 0.0, 0.0, 1.0]), (200, [-1.7e308, 1e-300, 5e15, 4.4e12]), (201, [2.0**41, 1.0, -1.0, 3.0]), (300, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in top_k(df, 10, 100).collect()) == brute(rows, 10, 100)


def test_sortable_bytes():
    from arcmesh.llm.topk import sortable

    n = sorted([0, 1, -1, 255, 256, -255, -256, 2**70, -(2**70), 2**64, 10**600, -(10**600), 7])
    assert [sortable(x) for x in n] == sorted(sortable(x) for x in n)


def test_the_bounds_skip_candidates():
    from arcmesh.llm import topk

    rng = np.random.default_rng(0)
    rows = np.vstack([rng.integers(900, 1000, (300, 8)), rng.integers(-1000, -900, (4000, 8))]).astype(float)
    q = rows[0]
    pivots = topk.pick_pivots(rows[::50], 4)
    lower = np.abs(topk.distances(rows, pivots) - topk.distances(q[None], pivots)).max(axis=1)
    seen, scores = [], topk.scores
    topk.scores = lambda r, *x: seen.append(len(r)) or scores(r, *x)
    try:
        best = topk.improved([], 0, q / 1024, q, np.arange(len(rows)), rows / 1024, rows, 5, lower, (rows**2).sum(axis=1))
        first = sum(seen)
        again = topk.improved(best, 0, q / 1024, q, np.arange(1000, 1000 + len(rows)), rows / 1024 - 1, rows - 1024, 5, np.abs(topk.distances(rows - 1024, pivots) - topk.distances(q[None], pivots)).max(axis=1), ((rows - 1024) ** 2).sum(axis=1))
    finally:
        topk.scores = scores
    want = sorted(((-int(s), i) for i, s in enumerate(rows @ q) if i))[:5]
    assert [(-s, i) for s, i in best] == want and first < len(rows) / 4
    assert again == best and sum(seen) - first < len(rows) / 4  # the bound found before goes on
