"""Exact products: against all pairs, with runs, groups and buckets of a few rows, copies, ties and very large values."""

import math

import numpy as np
import pytest

from pagemill.llm import norm_search as N

SCHEMA = "vec_id long, embedding array<float>, label int, run string, norm int, v string"


def ints(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    x = [math.floor(64 * float(c)) for c in v]
    return x if sum(c * c for c in x) < 2**62 else None


def brute(rows, every=20, k=20):
    x = sorted({(i, tuple(ints(v))) for i, v in rows if i is not None and ints(v) is not None})
    best = {}
    for i, a in x:
        for j, b in x:
            if i % every == 0 and i != j and len(a) == len(b):
                s = sum(p * q for p, q in zip(a, b, strict=True))
                best[i, j] = max(best.get((i, j), s), s)
    out = {}
    for (i, j), s in best.items():
        out.setdefault(i, []).append((-s, j))
    return sorted((i, r, j, -s) for i, found in out.items() for r, (s, j) in enumerate(sorted(found)[:k], 1))


def run(spark, rows, **kw):
    got = N.top_products(spark.createDataFrame([(i, v, 0, "", 1, "x") for i, v in rows], SCHEMA), **kw)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(tuple(r) for r in got.collect())


def vectors(seed, n=300, dim=8, spread=1.0):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dim)) * draw.lognormal(0, spread, size=(n, 1))
    return [(i, v) for i, v in enumerate(x.astype(np.float32).astype(float).tolist())]


@pytest.fixture
def small(monkeypatch):
    for name, value in {"RUN_ROWS": 40, "GROUP_ROWS": 5, "BUCKET_ROWS": 7, "SEEDS": 30, "LEVELS": 3}.items():
        monkeypatch.setattr(N, name, value)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_many_runs_and_groups(spark, small, spread):
    rows = vectors(1, spread=spread)
    assert run(spark, rows, k=4) == brute(rows, k=4)


def test_whole_runs_are_left_out(spark, small):
    """With lengths far apart a query sees the first runs only."""
    rows = [(i, [c / 2 ** (i // 30) for c in v]) for i, v in vectors(2, 300, spread=0.0)]
    assert run(spark, rows, k=3) == brute(rows, k=3)


def test_copies_and_ties(spark, small):
    rows = [(i, [0.5, 0.25, -0.5]) for i in range(150)] + [(i, [0.5, 0.3, -0.4]) for i in range(150, 170)]
    assert run(spark, rows, k=6) == brute(rows, k=6)


def test_edge_rows(spark):
    nan = float("nan")
    rows = [(0, None), (20, [nan, 1.0]), (40, [None, 1.0]), (60, [float("inf"), 0.0]), (80, []), (100, [0.0, 0.0]), (1, [1.0, -1.0]), (2, []), (3, [1.0, 2.0, 3.0])]
    rows += [(120, [1.0, 2.0]), (120, [-3.0, 0.5]), (120, [1.0, 2.0]), (7, [2.0, 2.0]), (7, [-2.0, 0.1]), (None, [5.0, 5.0]), (-20, [0.01, -0.01])]
    rows += [(140, [3e7, 0.0]), (160, [3.2e7, 1.0]), (161, [3.3e7, -1.0]), (180, [1.0, 1.0, 1.0, 1.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_products_beyond_doubles():
    q = N.Block(np.array([1]), np.array([[2**30 + 1, 3]]), np.array([(2**30 + 1) ** 2 + 9]))
    assert N.products(q, q).tolist() == [[(2**30 + 1) ** 2 + 9]]


def block(ids, x):
    return N.Block(np.array(ids), x, (x**2).sum(axis=1))


@pytest.mark.parametrize("seed", range(4))
def test_coordinate_pruning_keeps_all(seed):
    """Clustered directions make high thresholds; coordinates then leave few rows, and none is lost."""
    draw = np.random.default_rng(seed)
    x = np.repeat(draw.normal(size=(60, 16)), 30, axis=0) * 50 + draw.normal(size=(1800, 16)) * 3
    x = np.floor(x / np.linalg.norm(x, axis=1, keepdims=True) * 640).astype(np.int64)
    v, q, stats = block(np.arange(1800), x), block(np.arange(0, 1800, 20), x[::20]), {}
    scores = q.x @ v.x.T
    scores[q.ids[:, None] == v.ids] = -(2**60)
    kth = np.sort(scores, axis=1)[:, -10]
    got = N.search(q, v, 10, kth, stats)
    want = [(-scores[i, j], j) for i in range(len(q)) for j in np.lexsort((v.ids, -scores[i]))[:10]]
    assert list(zip((-got.score).tolist(), got.ids.tolist(), strict=True)) == want
    assert 0 < stats["coordinate"] < len(q) * len(v) / 4
    assert stats.get("length", 0) == 0


def test_length_pruning():
    draw = np.random.default_rng(9)
    x = draw.normal(size=(4000, 4)) * draw.lognormal(0, 1.5, size=(4000, 1)) * 64
    x, stats = np.floor(x).astype(np.int64), {}
    v, q = block(np.arange(4000), x), block(np.arange(0, 4000, 20), x[::20])
    got = N.search(q, v, 5, np.full(len(q), N.NONE), stats)
    scores = q.x @ v.x.T
    scores[q.ids[:, None] == v.ids] = -(2**60)
    assert got.ids.tolist() == [int(j) for i in range(len(q)) for j in np.lexsort((v.ids, -scores[i]))[:5]]
    assert stats["length"] + stats.get("coordinate", 0) < len(q) * len(v) * 0.9
