"""Folded groups and rounds give the same rows; long chains need no rounds."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagemill.operators import folds, graphs, matching
from pagemill.operators import ordered as od


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.fixture(params=[1 << 17, 0])
def limit(request, monkeypatch):
    monkeypatch.setattr(folds, "FOLD_ROWS", request.param or 1)
    if not request.param:
        real = folds.sized
        split = lambda df, by, name: (real(df, by, name)[1].limit(0), df)
        for module in (graphs, matching):
            monkeypatch.setattr(module, "sized", split)
    return request.param


def test_suppress(spark, limit):
    draw = random.Random(1)
    edges = {(g, *sorted(draw.sample(range(12), 2))) for g in "ab" for _ in range(14)}
    items = spark.createDataFrame([(g, k) for g in "abc" for k in range(12)], "g string, k int")
    conflicts = spark.createDataFrame(sorted(edges), "g string, better int, worse int")
    want = []
    for g in "abc":
        kept = []
        for k in range(12):
            if not any((g, b, k) in edges for b in kept):
                kept.append(k)
        want += [(g, k) for k in kept]
    assert rows(graphs.suppress(items, conflicts, ["g"], "k"), "g", "k") == want


def test_pairs(spark, limit):
    draw = random.Random(2)
    data = [(g, i, j, draw.randrange(6) / 2) for g in range(3) for i in range(7) for j in range(6)]
    want = []
    for g in range(3):
        left, right = set(), set()
        for _, i, j, s in sorted((r for r in data if r[0] == g), key=lambda r: (-r[3], r[1], r[2])):
            if i not in left and j not in right:
                left.add(i), right.add(j), want.append((g, i, j, s))
    df = spark.createDataFrame(data, "g int, i int, j int, score double")
    assert rows(matching.greedy_pairs(df, ["g"]), "g", "i", "j", "score") == sorted(want)


def test_eliminate(spark, limit):
    draw = random.Random(3)
    data = [(g, k, float(k), float(draw.randrange(8))) for g in range(4) for k in range(15)]

    def bad(p, q):
        return 0 if p is None or q is None else int(abs((q[3] - p[3]) / (q[2] - p[2])) > 2)

    want = []
    for g in range(4):
        line = [r for r in data if r[0] == g]
        while True:
            at = lambda k: line[k] if 0 <= k < len(line) else None  # noqa: B023, E731
            gain = [bad(at(k - 1), at(k)) + bad(at(k), at(k + 1)) - bad(at(k - 1), at(k + 1)) for k in range(len(line))]
            if max(gain) <= 0:
                break
            del line[gain.index(max(gain))]
        want += [(g, r[1]) for r in line]
    df = spark.createDataFrame(data, "g int, seq int, x double, y double")
    assert rows(graphs.eliminate(df, ["g"], -2.0, 2.0), "g", "seq") == want


def test_lines_without_a_gain_are_not_walked(spark, monkeypatch):
    """Only lines where some point has a gain take the heap, and none is written first; equal and missing places are no slope."""
    names, walked = [], []
    for module in (graphs, folds, od):
        monkeypatch.setattr(module, "staged", lambda df, name="stage", write=module.staged: (names.append(name), write(df, name))[1])
    nan = float("nan")
    data = [(g, k, float(k), float(k % 2)) for g in range(40) for k in range(5)]
    data += [(50, 0, 0.0, 0.0), (50, 1, 0.0, 9.0), (50, 2, 1.0, nan), (51, 0, 0.0, 0.0), (51, 1, 1.0, 9.0), (51, 2, 2.0, 0.0), (52, 0, 0.0, 9.0)]
    df = spark.createDataFrame(data, "g int, seq int, x double, y double")
    assert rows(graphs.eliminate(df, ["g"], -2.0, 2.0), "g", "seq") == sorted(r[:2] for r in data if r[:2] != (51, 1))
    assert set(names) == {"large"}
    monkeypatch.setattr(folds.heapq, "heapify", walked.append)
    folds.drop_steep(["g"], -2.0, 2.0)(pd.DataFrame(data, columns=["g", "seq", "x", "y"]))
    assert len(walked) == 1


def test_paths(spark, limit):
    edges = [(1, 2), (2, 3), (3, 4), (3, 9), (20, 21), (30, 31), (31, 32), (32, 30)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = rows(graphs.longest_path(df), "component", "step", "node", "length")
    assert [r for r in got if r[0] == 20] in ([(20, 0, 21, 1), (20, 1, 20, 1)], [(20, 0, 20, 1), (20, 1, 21, 1)])
    assert {r[2] for r in got if r[0] == 1} == {1, 2, 3, 4} and not [r for r in got if r[0] == 30]


def test_long_chains_take_no_rounds(spark, monkeypatch):
    """5,000 conflicts, points or cells in a row: only the staged tables of one pass are written."""
    made = []
    for module in (graphs, matching, folds, od):
        monkeypatch.setattr(module, "staged", lambda df, name="stage", real=folds.staged: made.append(name) or real(df, name))
    chain = spark.range(5000).select(F.lit(1).alias("g"), F.col("id").alias("better"), (F.col("id") + 1).alias("worse"))
    items = spark.range(5001).select(F.lit(1).alias("g"), F.col("id").alias("k"))
    assert graphs.suppress(items, chain, ["g"], "k").count() == 2501
    points = spark.range(5000).select(F.lit(1).alias("g"), F.col("id").alias("seq"), F.col("id").cast("double").alias("x"), (F.col("id") % 2 * 9.0).alias("y"))
    assert graphs.eliminate(points, ["g"], -2.0, 2.0).count() < 5000
    path = spark.range(5000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graphs.longest_path(path).agg(F.max("length"), F.count("node")).first() == (5000, 5001)
    assert len(made) <= 25


def never(*_):
    raise AssertionError("no rounds expected")


@pytest.fixture
def tight(monkeypatch):
    """Ten rows fit a task; whatever needs rounds fails."""
    monkeypatch.setattr(folds, "FOLD_ROWS", 10)
    for module, name in ((graphs, "_suppress_rounds"), (graphs, "_eliminate_rounds"), (matching, "_pair_rounds")):
        monkeypatch.setattr(module, name, never)


def test_rivals_of_a_large_group_in_parts(spark, tight):
    """Chains a > b > c > d in one group (and in the group of rows without one): each chain is decided in a task."""
    chains = [(g, k * 10 + s, k * 10 + s + 1) for g in ("a", None) for k in range(40) for s in range(3)]
    items = spark.createDataFrame([("a", k * 10 + s) for k in range(40) for s in range(4)], "g string, k int")
    got = graphs.suppress(items, spark.createDataFrame(chains, "g string, better int, worse int"), ["g"], "k")
    assert rows(got, "k") == [(k * 10 + s,) for k in range(40) for s in (0, 2)]


def test_pairs_of_a_large_group_in_parts(spark, tight):
    """Left and right items have the same numbers and are still different items."""
    data = [(1, 3 * k + a, 3 * k + b, float((a * 2 + b * 5) % 7)) for k in range(30) for a in range(3) for b in range(3)]
    want = []
    for k in range(30):
        left, right = set(), set()
        for g, i, j, s in sorted((r for r in data if r[1] // 3 == k), key=lambda r: (-r[3], r[1], r[2])):
            if i not in left and j not in right:
                left.add(i), right.add(j), want.append((g, i, j, s))
    assert rows(matching.greedy_pairs(spark.createDataFrame(data, "g int, i int, j int, score double"), ["g"]), "g", "i", "j", "score") == sorted(want)


def spiky(draw, n):
    """Flat stretches with bursts of up to four wild points."""
    y = []
    while len(y) < n:
        y += [0.0] * draw.randrange(2, 6) + [float(draw.randrange(-9, 9)) for _ in range(draw.randrange(4))]
    return y[:n]


def test_lines_of_a_large_group_in_stretches(spark, tight):
    draw = random.Random(6)
    data = [(g, k, float(k), y) for g in range(3) for k, y in enumerate(spiky(draw, 150))]
    df = spark.createDataFrame(data, "g int, seq int, x double, y double")
    got = rows(graphs.eliminate(df, ["g"], -2.0, 2.0), "g", "seq", "x", "y")
    import pandas as pd

    want = folds.drop_steep(["g"], -2.0, 2.0)(pd.DataFrame(data, columns=["g", "seq", "x", "y"]))
    assert got == sorted(want.itertuples(index=False, name=None))
    assert len(got) < len(data)


@pytest.mark.parametrize("seed", range(3))
def test_components_over_levels(spark, monkeypatch, seed):
    """Random graphs, long paths with mixed ids, and stars, contracted in tasks of a few edges."""
    monkeypatch.setattr(graphs, "CONTRACT_ROWS", 16)
    draw = random.Random(seed)
    ids = draw.sample(range(10_000), 300)
    edges = list(zip(ids[:100], ids[1:101], strict=True)) + [(ids[120], k) for k in ids[121:170]] + [tuple(draw.sample(ids[170:280], 2)) for _ in range(90)] + [(5, 5)]
    root = {k: k for k in [*ids, 5, 10_001]}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    nodes = spark.createDataFrame([(k,) for k in root], "id long")
    got = graphs.components(nodes, spark.createDataFrame(edges, "a long, b long"))
    assert rows(got, "id", "component") == sorted((k, find(k)) for k in root)


def test_components_inside_samples_take_one_level(spark, monkeypatch):
    """Paths of neighbouring ids end in the first contraction, but for those on the edge of two tasks."""
    made, rounds = [], []
    monkeypatch.setattr(graphs, "CONTRACT_ROWS", 4000)
    monkeypatch.setattr(graphs, "staged", lambda df, name="stage", real=graphs.staged: made.append(name) or real(df, name))
    monkeypatch.setattr(graphs, "_star_round", lambda *_: rounds.append(1))
    edges = spark.range(30_000).where("id % 10 <> 9").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = graphs.components(spark.range(30_000), edges)
    assert got.where("component <> id - id % 10").isEmpty()
    assert made.count("stars") <= 2 and not rounds


def holes(draw, groups, height, width, share):
    return [(g, y, x, None if draw.random() < share else float(draw.randrange(50))) for g in groups for y in range(height) for x in range(width)]


def nearest_known(data):
    out = []
    for g, y, x, v in data:
        near = [((y - a) ** 2 + (x - b) ** 2, a, b, w) for h, a, b, w in data if h == g and w is not None]
        out.append((g, y, x, v if v is not None or not near else min(near)[3]))
    return out


@pytest.mark.parametrize("limit", [1 << 17, 4])
def test_nearest_fill(spark, monkeypatch, limit):
    """Sparse and full grids, ties, one without any value; rows within and beyond the limit of a task."""
    from pagemill.operators import grids

    monkeypatch.setattr(folds, "FOLD_ROWS", limit)
    draw = random.Random(5)
    data = holes(draw, [1, 2], 6, 7, 0.6) + holes(draw, [3], 5, 9, 0.95) + holes(draw, [4], 3, 3, 1.0) + [(5, 0, 0, None), (5, 0, 2, 1.0), (5, 0, -2, 7.0), (5, 1, 0, 9.0)]
    got = grids.fill_nearest(spark.createDataFrame(data, "sample int, y int, x int, value double"))
    assert {r[:3]: r[3] for r in map(tuple, got.select("sample", "y", "x", "value").collect())} == {r[:3]: r[3] for r in nearest_known(data)}


@pytest.mark.parametrize("short", [64, 2])
def test_fill_of_many_small_grids_writes_nothing(spark, monkeypatch, short):
    """Grids that fit a task go through one fold; rows of few and of many columns alike, NaN is a known value."""
    from pagemill.operators import grids

    names = []
    for module in (grids, folds, od):
        monkeypatch.setattr(module, "staged", lambda df, name="stage", write=module.staged: (names.append(name), write(df, name))[1])
    monkeypatch.setattr(folds, "SHORT_ROW", short)
    draw = random.Random(short)
    data = holes(draw, range(30), 5, 6, 0.7) + [(40, 0, 0, None), (40, -9, 1 << 30, float("nan")), (40, 0, -(1 << 30), 3.0), (41, 0, 0, None)]
    got = {r[:3]: r[3] for r in map(tuple, grids.fill_nearest(spark.createDataFrame(data, "sample int, y int, x int, value double")).collect())}
    assert set(names) == {"large"} and len(got) == len(data)
    assert repr(got.pop((40, -9, 1 << 30))) == "nan"
    assert got == {r[:3]: r[3] for r in nearest_known(data) if r[:3] != (40, -9, 1 << 30)}


@pytest.mark.parametrize("seed", range(5))
def test_envelope(seed):
    """Every parabola that is least somewhere stays, those that only touch the envelope included."""
    draw = random.Random(seed)
    x = sorted(draw.sample(range(-20, 20), 12))
    f = [draw.randrange(12) ** 2 for _ in x]
    stack, starts = folds.envelope(x, f)
    for t in range(-25, 26):
        cost = [(t - a) ** 2 + b for a, b in zip(x, f, strict=True)]
        assert {k for k, c in enumerate(cost) if c == min(cost)} <= set(stack)
    assert all(a[0] * b[1] <= b[0] * a[1] for a, b in zip(starts[1:], starts[2:], strict=False))


def test_boxes_by_summed_area(spark):
    """Boxes inside, across and outside grids with gaps, null conditions and repeated cells."""
    from pagemill.operators import boxes as bx

    draw = random.Random(7)
    cells = [(g, y, x, draw.choice([True, True, True, True, False, None])) for g in (1, 2) for y in range(-2, 6) for x in range(3, 10) if g == 1 or draw.random() < 0.5] + [(2, 0, 4, True)]
    asked = [(g, k, *sorted(draw.uniform(-4, 8) for _ in "ab"), *sorted(draw.uniform(1, 12) for _ in "ab")) for g in (1, 2, 3) for k in range(60)]
    asked += [(1, 100, -9.0, 20.0, -9.0, 20.0), (1, 101, 2.0, 2.0, 4.0, 6.0), (1, 102, 2.0, 3.0, 4.0, 5.0), (1, 103, 5.0, 1.0, 4.0, 9.0)]
    want, share = [], []
    for g, k, y0, y1, x0, x1 in asked:
        inside = [c for h, y, x, c in cells if h == g and y0 <= y < y1 and x0 <= x < x1]
        known = [c for c in inside if c is not None]
        if inside:
            want.append((g, k, len(inside), all(known) if known else None))
        places = {(y, x) for h, y, x, c in cells if h == g and c and y0 <= y < y1 and x0 <= x < x1}
        share.append((g, k, len(places)))
    grid = spark.createDataFrame(cells, "sample int, y int, x int, ok boolean")
    boxes = spark.createDataFrame(asked, "sample int, box_id int, y0 double, y1 double, x0 double, x1 double")
    assert {r[:2]: r for r in map(tuple, bx.box_all(boxes, grid, F.col("ok")).select("sample", "box_id", "cells", "all").collect())} == {r[:2]: r for r in want}
    assert sorted(map(tuple, bx.box_inside(boxes, grid.where("ok")).select("sample", "box_id", "inside").collect())) == sorted(share)


def test_box_rows_do_not_grow_with_area(spark):
    """A box that covers a million cells asks for four."""
    from pagemill.operators import boxes as bx

    grid = spark.range(100).select(F.lit(1).alias("sample"), (F.col("id") / 10).cast("int").alias("y"), (F.col("id") % 10).cast("int").alias("x"))
    boxes = spark.range(50).select(F.lit(1).alias("sample"), F.col("id").alias("box_id"), F.lit(-1e6).alias("y0"), F.lit(1e6).alias("y1"), F.lit(-1e6).alias("x0"), F.lit(1e6).alias("x1"))
    plan = bx.box_sums(boxes, grid, {})._jdf.queryExecution().toString()
    assert {r["cells"] for r in bx.box_sums(boxes, grid, {}).collect()} == {100}
    assert "sequence(cast(ceil" not in plan.lower()
