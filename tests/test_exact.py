"""Operators held against plain versions on small data, with small limits for the ways large groups take."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import folds, graphs, matching
from pagemill.operators import measures as ms
from pagemill.operators import texts as tx


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.mark.parametrize("steps", [100, 7])
def test_best_angle(spark, steps):
    draw = random.Random(steps)
    number = lambda: round(draw.uniform(-300, 300), 2)
    data = [(g, number(), number(), number(), number(), draw.choice(["text_line", "box", None])) for g in range(6) for _ in range(g * 4 + 1)]
    data += [(0, 1.0, 1.0, 1.0, 1.0, "box"), (1, None, 0.0, 5.0, 5.0, "box"), (7, 2.0, 2.0, 2.0, 2.0, "text_line"), (8, 0.0, 0.0, 3.0, 0.0, "text_line"), (None, 0.0, 0.0, 0.0, 4.0, "box")]
    data += [(9, 0.0, 0.0, 1e6, 1.0, "box")] * 40
    got = {r.g: (r.k, r.angle, r.score) for r in ms.best_angle(spark.createDataFrame(data, "g int, ax double, ay double, bx double, by double, type string"), ["g"], steps).collect()}

    def cost(group, k):
        total = 0.0
        for g, ax, ay, bx, by, kind in data:
            if g == group and ax is not None and (ax, ay) != (bx, by):
                period = math.pi if kind == "text_line" else math.pi / 2
                turned = math.atan2(by - ay, bx - ax) - math.pi / 2 + math.pi * k / (steps - 1)
                total += (math.hypot(bx - ax, by - ay) * (turned - period * round(turned / period))) ** 2
        return total

    assert set(got) == {g for g, *_ in data}
    for g, (k, angle, score) in got.items():
        costs = [cost(g, n) for n in range(steps)]
        near = pytest.approx(min(costs), rel=1e-9, abs=max(2e-6, 1e-16 * sum((bx - ax) ** 2 + (by - ay) ** 2 for h, ax, ay, bx, by, _ in data if h == g and ax is not None)))
        assert score == near and costs[k] == near
        assert angle == pytest.approx(-math.pi / 2 + math.pi * k / (steps - 1))
    assert got[7][0] == 0 and got[7][2] == 0


def test_banded_distance_is_exact(spark):
    draw = random.Random(3)
    text = lambda n: "".join(draw.choices("abcdé ", k=n))
    data = [(text(a), text(b)) for a in (0, 1, 60, 64, 65, 300, 900) for b in (0, 3, 64, 66, 600, 1500)]
    for n in (70, 600, 5000):
        whole = text(n)
        data += [(whole, whole), (whole, whole[: n // 2] + "x" + whole[n // 2 :]), (whole, whole[40:]), (whole[: n - 33], whole[35:] + "yy")]
    df = spark.createDataFrame([*data, (None, "a"), ("a", None)], "t string, f string")
    got = tx.text_errors(df, "t", "f").select("distance", F.levenshtein("t", "f").alias("plain")).collect()
    assert len(got) == len(data) + 2 and all(r.distance == r.plain for r in got)


def longest_run(a, b, n):
    best = None
    for i, j in itertools.product(range(len(a)), range(len(b))):
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        if k >= n:
            best = min(best or (0, 0, 0), (-k, i, j))
    return best and (best[1], best[2], -best[0])


@pytest.mark.parametrize("n", [1, 3])
def test_longest_common_run(spark, n):
    draw = random.Random(n)
    text = lambda most: "".join(draw.choices("abé", k=draw.randint(0, most)))
    left, right = [(k, text(14)) for k in range(12)] + [(90, None)], [(k, text(30)) for k in range(12)] + [(91, None)]
    got = rows(tx.lcs_align(spark.createDataFrame(left, "k int, a string"), spark.createDataFrame(right, "m int, b string"), n, ["k"], ["m"]), "k", "m", "i", "j", "length")
    want = [(k, m, *longest_run(a, b, n)) for k, a in left for m, b in right if a and b and longest_run(a, b, n)]
    assert got == sorted(want)


def test_one_letter_many_times(spark):
    """Two texts of one letter have millions of equal places; they stay one row."""
    a = spark.createDataFrame([(1, "z" * 4000)], "k int, a string")
    b = spark.createDataFrame([(2, "y" + "z" * 5000)], "m int, b string")
    assert rows(tx.lcs_align(a, b, 6, ["k"], ["m"]), "k", "m", "i", "j", "length") == [(1, 2, 0, 1, 4000)]


@pytest.fixture
def tours(monkeypatch):
    """Ten rows fit a task; counts the rounds of the walk around larger trees."""
    monkeypatch.setattr(folds, "FOLD_ROWS", 10)
    made = []
    monkeypatch.setattr(graphs, "staged", lambda df, name="stage", real=graphs.staged: made.append(name) or real(df, name))
    return made


def test_paths_by_tour(spark, tours, monkeypatch):
    draw = random.Random(8)
    edges = []
    for tree, size in enumerate((12, 25, 40, 2)):
        names = draw.sample(range(tree * 100, tree * 100 + 90), size)
        edges += [(names[k], names[draw.randrange(max(0, k - 4), k)]) for k in range(1, size)]
    edges += [(500, k) for k in range(501, 530)] + [(700, 701), (701, 702), (702, 700)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = rows(graphs.longest_path(df), "component", "step", "node", "length")
    monkeypatch.setattr(folds, "FOLD_ROWS", 1 << 17)
    assert got == rows(graphs.longest_path(df), "component", "step", "node", "length")


def test_a_long_path_takes_few_rounds(spark, tours):
    path = spark.range(100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graphs.longest_path(path).agg(F.max("length"), F.count("node")).first() == (100, 101)
    assert tours.count("walk") <= math.ceil(math.log2(200)) + 2


def most(scores):
    """Largest total of one-to-one pairs, by trying all."""
    best = {frozenset(): 0.0}
    for i in sorted({i for i, _ in scores}):
        after = dict(best)
        for used, total in best.items():
            for (a, j), w in scores.items():
                if a == i and w > 0 and j not in used:
                    key = used | {j}
                    after[key] = max(after.get(key, 0.0), total + w)
        best = after
    return max(best.values())


def drawn(seed, groups, side, share):
    draw = random.Random(seed)
    return {(g, i, j): round(draw.uniform(-0.2, 1.0), draw.choice([1, 3])) for g in groups for i in range(side) for j in range(side) if draw.random() < share}


def checked(got, data, slack):
    assert len({(g, i) for g, i, _, _ in got}) == len(got) == len({(g, j) for g, _, j, _ in got})
    assert all(data[g, i, j] == w > 0 for g, i, j, w in got)
    for group in {g for g, _, _ in data}:
        best, total = most({(i, j): w for (g, i, j), w in data.items() if g == group}), sum(w for g, _, _, w in got if g == group)
        assert best - slack <= total <= best + 1e-9


@pytest.mark.parametrize("fold_rows", [1 << 17, 10])
def test_optimal_pairs(spark, monkeypatch, fold_rows):
    """In one pass, and in parts of a group that share no item."""
    monkeypatch.setattr(folds, "FOLD_ROWS", fold_rows)
    monkeypatch.setattr(matching, "_auction", None)
    data = drawn(1, "ab", 6, 0.7) | drawn(2, "cd", 7, 0.3) if fold_rows > 10 else {(g, p * 9 + i, p * 9 + j): w for p in range(5) for (g, i, j), w in drawn(p, "ab", 3, 0.9).items()}
    df = spark.createDataFrame([(*k, w) for k, w in data.items()] + [("a", 0, 0, None)], "g string, i int, j int, score double")
    checked(rows(matching.optimal_pairs(df, ["g"]), "g", "i", "j", "score"), data, 1e-9)
    assert matching.optimal_pairs(df.limit(0), ["g"]).count() == 0


def test_auction(spark, monkeypatch):
    """Parts that fit no task, with a rival for every item."""
    monkeypatch.setattr(folds, "FOLD_ROWS", 5)
    data = drawn(5, "ab", 4, 1.0)
    df = spark.createDataFrame([(*k, w) for k, w in data.items()], "g string, i int, j int, score double")
    checked(rows(matching.optimal_pairs(df, ["g"], tolerance=0.1), "g", "i", "j", "score"), data, 4 * 0.1)


def test_greedy_is_not_optimal(spark):
    df = spark.createDataFrame([(1, 1, 1, 1.0), (1, 1, 2, 0.9), (1, 2, 1, 0.9)], "g int, i int, j int, score double")
    assert rows(matching.greedy_pairs(df, ["g"]), "i", "j") == [(1, 1)]
    assert rows(matching.optimal_pairs(df, ["g"]), "i", "j") == [(1, 2), (2, 1)]
