"""Neighbours along curves: recall against all pairs, exact scores, ties, salted tiles, edge cases."""

import itertools

import numpy as np
import pytest

from pagemill.llm import curve_neighbours as C
from pagemill.llm.hilbert import hilbert_keys

SCHEMA = "vec_id long, embedding array<float>, score string, block int, v string"


def brute(ids, x, every=100, k=10):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            d = np.sqrt(((x - q) ** 2).sum(axis=1))
            out[i] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def recall_and_scores(got, want):
    hit = total = 0
    for q in {r.query_id for r in got} | set(want):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(want[q]) + 1))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hit += len({r.vec_id for r in mine} & {v for v, _ in want[q]})
        total += len(want[q])
    return hit / total


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_keys(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_recall_on_the_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    got = C.nearest(vectors).collect()
    assert recall_and_scores(got, brute(ids, x)) >= 0.93
    at = {i: v for i, v in zip(ids.tolist(), x, strict=True)}
    assert all(r.score == pytest.approx(float(np.sqrt(((at[r.vec_id] - at[r.query_id]) ** 2).sum())), rel=1e-14) for r in got)


def test_narrow_windows_on_clusters(spark):
    """Clustered vectors are found through few blocks."""
    draw = np.random.default_rng(2)
    x = (np.repeat(draw.normal(size=(300, 32)), 20, axis=0) + 0.05 * draw.normal(size=(6000, 32))).astype(np.float32).astype(float)
    assert C.fit(x[:4096]).reach <= 2
    docs = spark.createDataFrame([(i, v.tolist(), "", 0, "") for i, v in enumerate(x)], SCHEMA)
    assert recall_and_scores(C.nearest(docs).collect(), brute(np.arange(6000), x)) >= 0.93


def test_copies_are_salted(spark, monkeypatch):
    """Half of the rows are one vector; small tiles split its block, and ties go to the smaller ids."""
    monkeypatch.setattr(C, "TILE", 16)
    draw = np.random.default_rng(3)
    x = np.concatenate([np.tile(draw.normal(size=4), (150, 1)), draw.normal(size=(150, 4))]).astype(np.float32).astype(float)
    ids = draw.permutation(300)
    docs = spark.createDataFrame([(int(i), v.tolist(), "", 0, "") for i, v in zip(ids, x, strict=True)], SCHEMA)
    got = C.nearest(docs, every=10, target=1.0).collect()
    want = brute(ids, x, 10)
    copies = {int(i) for i, v in zip(ids, x, strict=True) if (v == x[0]).all()}
    for q in copies & set(want):
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want[q]
    assert recall_and_scores(got, want) >= 0.97


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (1, [1.0, 3.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (100, [1.0, 2.0]), (9, [-1.0, 0.0])]
    docs = spark.createDataFrame([(i, v, "", 0, "") for i, v in rows], SCHEMA)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in C.nearest(docs).collect())
    far = 8**0.5
    assert got == [(0, 1, 100, 0.0), (0, 2, 1, 0.5), (0, 3, 9, pytest.approx(far)), (100, 1, 0, 0.0), (100, 2, 1, 0.5), (100, 3, 9, pytest.approx(far))]
    assert C.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.nearest(docs.where("vec_id = 0")).count() == 0 and C.nearest(docs.where("vec_id = 2")).count() == 0


@pytest.mark.parametrize("apart", [0.0, 1e-3])
def test_an_id_in_many_rows_is_one_candidate(spark, apart):
    """Thirty rows of one id, equal or nearly so, stand nearest to the query and take one rank."""
    draw = np.random.default_rng(6)
    many = [1.0, 0.0] + apart * draw.random((30, 2))
    rows = [(0, [1.0, 0.01])] + [(1, v.tolist()) for v in many] + [(k, [1.0, 0.1 * k]) for k in range(2, 20)]
    docs = spark.createDataFrame([(i, v, "", 0, "") for i, v in rows], SCHEMA)
    got = sorted(C.nearest(docs, target=1.0).collect(), key=lambda r: r["rank"])
    assert [r.vec_id for r in got] == list(range(1, 11))
    assert got[0].score == pytest.approx(min(np.hypot(*(np.float32(v).astype(float) - np.float32([1.0, 0.01]).astype(float))) for v in many))
