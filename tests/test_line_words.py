"""Words of lines: cut and paired inside their row, against the general form."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.operators import matching as mt
from pagemill.operators import words as wd
from pagemill.plans.catalog import QUERIES
from pagemill.plans.match_queries import word_components
from pagemill.plans.views import Tables


def test_words_of_lines_move_no_rows(spark, folder):
    plan = Tables(spark, folder).words._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_cuts_count_characters(spark):
    df = spark.createDataFrame([(1, " ä  bc 😀d "), (2, ""), (3, "   "), (4, None), (5, "x")], "k int, text string")
    got = {(r.k, r.word_no, r.start, r.text) for r in wd.line_words(df, ["k"]).collect()}
    assert got == {(1, 1, 1, "ä"), (1, 3, 4, "bc"), (1, 4, 7, "😀d"), (5, 0, 0, "x")}
    lengths = {r.k: r.length for r in wd.with_cuts(df).collect()}
    assert lengths == {1: [1, 2, 2], 2: [], 3: [], 4: None, 5: [1]}


def test_batches_are_cut_as_single_texts(monkeypatch):
    """Texts of a batch are cut together, in parts of any size."""
    draw = random.Random(1)
    texts = [None if k % 9 == 0 else "".join(draw.choice(" aä😀b  ") for _ in range(draw.choice([0, 1, 2, 5, 30]))) for k in range(200)]
    want = []
    for text in texts:
        pieces, at, found = (text or "").split(" "), 0, []
        for no, piece in enumerate(pieces):
            found += [(no, at, len(piece))] if piece else []
            at += len(piece) + 1
        want.append(dict.fromkeys(("word_no", "start", "length")) if text is None else {c: [f[k] for f in found] for k, c in enumerate(("word_no", "start", "length"))})
    for most in (1, 40, 1 << 22):
        monkeypatch.setattr(wd, "CUT_BYTES", most)
        assert wd._cuts.func(pa.array(texts)).to_pylist() == want
        assert wd._cuts.func(pa.array(texts)[3:-2]).to_pylist() == want[3:-2]


@pytest.fixture(scope="module")
def lines(spark):
    """Pages whose lines lie apart, touch, or lie in each other; words in no order, of several heights, some missing."""
    draw = random.Random(5)
    rows = []
    for page in range(12):
        step = (20.0, 10.0, 0.4)[page % 3]
        for line in range(15):
            n = draw.randrange(0, 12)
            top = [line * step + draw.choice([0.0, 0.0, 0.4]) for _ in range(n)]
            boxes = [[float(draw.randrange(0, 150)) for _ in range(n)], top, [float(draw.randrange(1, 30)) for _ in range(n)], [draw.choice([10.0, 10.0, 10.5, 5.0, 0.0]) for _ in range(n)]]
            rows.append((page, line, draw.sample(range(40), n), *boxes))
    rows.append((99, 0, [0, 1], [0.0, None], [0.0, 0.0], [5.0, 5.0], [10.0, 10.0]))
    kinds = ", ".join(f"{c} array<double>" for c in wd.SIDES)
    return spark.createDataFrame(rows, f"doc_id long, line_no int, word_no array<int>, {kinds}")


def test_line_pairs_are_those_of_loose_words(spark, lines):
    columns = ["doc_id", "a_line_no", "a_word_no", "b_line_no", "b_word_no", "gap"]
    got = sorted(map(tuple, wd.line_word_pairs(lines, ["doc_id"], "line_no", "word_no").select(*columns).collect()))
    want = sorted(map(tuple, wd.word_pairs(wd.in_boxes(lines, "word_no"), ["doc_id"], ["line_no", "word_no"]).select(*columns).collect()))
    assert got == want and any(r[1] != r[3] for r in want) and any(r[1] == r[3] for r in want)


def test_split_apart_knows_touching_lines(spark, lines):
    apart, rest = wd.split_apart(lines.where(F.size("word_no") > 0), ["doc_id"], "line_no")
    pages = {r.doc_id % 3 for r in rest.select("doc_id").where("doc_id < 99").distinct().collect()}
    assert 2 in pages and 0 not in pages
    assert apart.where("doc_id % 3 = 0").count() > 0


def test_line_runs_are_components(spark, lines):
    apart, _ = wd.split_apart(lines.where(F.size("word_no") > 0), ["doc_id"], "line_no")
    columns = ["doc_id", "line_no", "word_no", "first"]
    got = sorted(map(tuple, wd.line_runs(apart, ["doc_id"], "line_no", "word_no").select(*columns).collect()))
    want = sorted(map(tuple, word_components(wd.in_boxes(apart, "word_no")).withColumnRenamed("first_word", "first").select(*columns).collect()))
    assert got == want and any(r[2] != r[3] for r in want)


def test_overlapping_words_are_those_of_loose_words(spark, lines, monkeypatch):
    draw = random.Random(6)
    rows = []
    for r in lines.where("doc_id < 99").collect():
        n = draw.randrange(0, 12)
        moved = [[float(draw.randrange(0, 150)) for _ in range(n)], [draw.choice([0.0, 0.4]) + r.line_no * (20.0, 10.0, 0.4)[r.doc_id % 3] for _ in range(n)]]
        texts = [[f"{side}{r.line_no}-{k}" for k in range(m)] for side, m in (("a", len(r.word_no)), ("b", n))]
        rows.append((r.doc_id, r.line_no, r.word_no, texts[0], r.left, r.top, r.width, r.height, list(range(n)), texts[1], *moved, [20.5 + k for k in range(n)], [10.0] * n))
    kinds = ", ".join(f"{s}_word_no array<int>, {s}_text array<string>, " + ", ".join(f"{s}_{c} array<double>" for c in wd.SIDES) for s in "ab")
    both = spark.createDataFrame(rows, f"doc_id long, line_no int, {kinds}")
    found = lambda: sorted(map(str, mt.overlapping_words(both, ["doc_id"], "line_no", "word_no").collect()))
    got = found()
    monkeypatch.setattr(wd, "PAIRS_IN_A_LINE", -1)  # all words meet in cells
    assert got == found() and len(got) == sum(len(r[2]) for r in rows) and any("None" in r for r in got)


def one_line_of_words(spark, n, step):
    """Two sides of one line; every word meets those of the other side that start within its width of 5."""
    sides = [[step * k + moved for k in range(n)] for moved in (0.0, 1.0)]
    row = [1, 0]
    for left in sides:
        row += [list(range(n)), [f"w{k}" for k in range(n)], left, [0.0] * n, [5.0] * n, [10.0] * n]
    kinds = ", ".join(f"{s}_word_no array<int>, {s}_text array<string>, " + ", ".join(f"{s}_{c} array<double>" for c in wd.SIDES) for s in "ab")
    return spark.createDataFrame([tuple(row)], f"doc_id long, line_no int, {kinds}")


def test_long_lines_with_few_meetings_stay_whole(spark):
    """1,100 words a side could make more pairs than a line may, but just 1,100 meet."""
    args = (["doc_id"], "line_no", ("a_", "b_"), wd.PAIRS_IN_A_LINE)
    assert wd.split_apart(one_line_of_words(spark, 1100, 10.0), *args)[1] is None
    assert wd.split_apart(one_line_of_words(spark, 1100, 0.0), *args)[1].count() == 1
    got = mt.overlapping_words(one_line_of_words(spark, 1100, 10.0), ["doc_id"], "line_no", "word_no").collect()
    assert len(got) == 1100 and all(r.truth_text == r.found_text for r in got)


def test_partners_of_parts_are_those_of_the_whole(monkeypatch):
    """Boxes with a missing side have no partner; parts of any size give the same pairs as all combinations."""
    draw = random.Random(8)
    number = lambda: draw.choice([None, float("nan"), *[float(draw.randrange(40)) for _ in range(20)]])
    sizes = [(draw.randrange(0, 7), draw.randrange(0, 7)) for _ in range(60)]
    args = [pa.array([[number() for _ in range(n[side])] for n in sizes], pa.list_(pa.float64())) for side in (0, 1) for _ in range(4)]
    flat = [np.nan_to_num(wd._flat(c)[0], nan=-1e9) for c in args]
    want = {(line, i, j) for line, i, j in _combinations(sizes, flat)}
    got = set()
    for words, pairs in ((1, 1), (9, 3), (1 << 17, 1 << 21)):
        monkeypatch.setattr(wd, "WORDS_TOGETHER", words)
        monkeypatch.setattr(wd, "PAIRS_TOGETHER", pairs)
        found = wd._line_partners.func(*args).to_pylist()
        assert [len(f) for f in found] == [n[0] for n in sizes]
        pairs = {(line, i, j) for line, f in enumerate(found) for i, j in enumerate(f) if j >= 0}
        assert pairs <= want and (not got or pairs == got)
        got = pairs
    met = wd._pairs_met.func(args[0], args[2], args[4], args[6]).to_pylist()
    assert sum(met) >= len(want) and {line for line, *_ in want} == {line for line, *_ in got}


def _combinations(sizes, flat):
    at = [0, 0]
    for line, (n, m) in enumerate(sizes):
        for i in range(n):
            for j in range(m):
                a, b = [c[at[0] + i] for c in flat[:4]], [c[at[1] + j] for c in flat[4:]]
                if min(*a, *b) >= 0 and all(min(a[k] + a[k + 2], b[k] + b[k + 2]) > max(a[k], b[k]) for k in (0, 1)):
                    yield line, i, j
        at = [at[0] + n, at[1] + m]


def test_word_errors_move_no_words(spark, folder):
    plan = QUERIES["a16_mean_normalized_cer"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
