"""Near copies against all pairs, families of graded similarity, hot groups split in blocks, components, edge cases."""

import random
from itertools import combinations

import numpy as np

from pagemill.llm import near_copies as N
from pagemill.llm.components import connected

SCHEMA = "doc_id long, text string, component string, u string, n_shingles string"


def sets(text, width):
    w = "".join(c.lower() if c < "\x80" else c for c in text or "").split(" ")
    w = [x for x in " ".join(w).replace("\n", " ").replace("\t", " ").split(" ") if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width):
    s = {i: sets(t, width) for i, t, *_ in rows}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(s), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {i: (len(s[i]), find(i)) for i in s}


def family(draw, start, n, words, edits):
    """Versions of one text, each a few edits from an earlier one: similarities of all degrees."""
    vocabulary = [f"w{k}" for k in range(500)]
    made = [[draw.choice(vocabulary) for _ in range(words)]]
    while len(made) < n:
        t = list(draw.choice(made))
        for _ in range(draw.randint(0, edits)):
            t[draw.randrange(len(t))] = draw.choice(vocabulary)
        made.append(t)
    return [(start + k, draw.choice([" ", "\n"]).join(t), "", "", "") for k, t in enumerate(made)]


def rows_of(seed):
    draw = random.Random(seed)
    rows = family(draw, 0, 60, 80, 3) + family(draw, 100, 60, 40, 2) + family(draw, 200, 30, 300, 20)
    rows += [(300 + k, " ".join(draw.choice("abcdefg") for _ in range(draw.randint(0, 6))), "", "", "") for k in range(60)]
    rows += [(400, "Same TEXT here", "", "", ""), (401, "same text\there", "", "", ""), (402, None, "", "", ""), (403, "", "", "", ""), (404, " \n ", "", "", ""), (405, "É é x y z", "", "", ""), (406, "é é x y z", "", "", "")]
    draw.shuffle(rows)
    return rows


def check(spark, rows, width):
    got = N.near_copies(spark.createDataFrame(rows, SCHEMA), width).collect()
    assert len(got) == len(rows)
    want = brute(rows, width)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_all_pairs(spark):
    check(spark, rows_of(1), 4)
    check(spark, rows_of(2), 5)


def test_hot_buckets_and_blocks(spark, monkeypatch):
    """Small bounds send buckets and groups down the ways for hot ones; results stay the same."""
    monkeypatch.setattr(N, "BUCKET", 3)
    monkeypatch.setattr(N, "GROUP", 700)
    check(spark, rows_of(3), 4)


def test_components(spark):
    draw = random.Random(5)
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, 1001 + k) for k in range(200)]
    loose = [(draw.randrange(2000, 2200), draw.randrange(2000, 2200)) for _ in range(120)]
    edges = chain + star + loose + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_minima_estimate_similarity():
    draw = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        both, a, b = (draw.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
        x, y = N.minima(np.concatenate([both, a])), N.minima(np.concatenate([both, b]))
        errors.append((x == y).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_edges(spark):
    rows = [(1, "a b c d e f", "", "", ""), (1, "a b c d e f", "", "", ""), (2, "a b c d e f", "", "", ""), (None, "a b c d e f", "", "", ""), (3, "x " * 200_000 + "y", "", "", ""), (4, "x " * 100_000 + "y", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in N.near_copies(docs, 4).fillna(0).collect())
    assert got == [(0, 3, 0, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 2, 3, True), (4, 2, 3, False)]
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 3]
    empty = spark.createDataFrame([], SCHEMA)
    assert N.near_copies(empty).count() == 0 and N.one_of_each(empty).count() == 0


def test_repeated_rows_stay_once_in_the_pipeline(spark):
    import corpus_pipeline

    rows = [(1, "a b c d e f", "", "", "")] * 5 + [(2, "a b c d e f", "", "", "")] + [(None, "g h i j k l", "", "", "")] * 3 + [(None, None, "", "", "")] * 2 + [(3, "other words here", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted({(r[0], r[1]) for r in rows if r[0] != 2}, key=str)
