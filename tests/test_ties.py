"""Undefined means, and shares at their limit."""

import math
import random

from pagemill.operators import boxes as bx
from pagemill.operators import measures as ms
from pagemill.operators import texts as tx
from pagemill.operators import words as wd
from pagemill.operators.matching import optimal_pairs


def test_f1_without_width_is_undefined(spark):
    gt = spark.createDataFrame([("two", 1.0, 5.0), ("two", 1.0, 5.0), ("one", 1.0, 5.0), ("alone", 1.0, 5.0), ("alone", 1.0, 5.0)], "g string, x double, y double")
    pred = gt.where("g <> 'alone'")
    got = {r.g: r for r in ms.series_f1(pred, gt, ["g"]).collect()}
    assert all(math.isnan(got["two"][c]) for c in ("recall", "precision", "f1"))
    assert got["one"].f1 == 1.0
    assert got["alone"].f1 == 0.0


def test_set_with_an_undefined_curve_is_undefined(spark):
    rows = [(g, s, float(x), 10.0 + 80 * s) for g, xs in (("flat", (1, 1)), ("wide", (1, 2)), ("alone", (1, 1))) for s in (0, 1) for x in xs]
    gt = spark.createDataFrame(rows, "g string, series int, x double, y double")
    pred = gt.where("g <> 'alone'")
    for pairing in ({}, {"pairing": optimal_pairs}):
        got = {r.g: r.score_6a for r in ms.series_set_score(pred, gt, ["g"], **pairing).collect()}
        assert math.isnan(got["flat"]) and got["wide"] == 1.0 and got["alone"] == 0.0


def test_share_of_lines_of_one_height(spark):
    """Nine tenths of 13 by 10 are 117.00000000000001 when multiplied from the left, and 117 are shared."""
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 20.0, 10.0), (1, 1, 0.0, 1.0, 13.0, 11.0)], "s int, k int, x0 double, y0 double, x1 double, y1 double")
    assert {r.k for r in bx.suppress_contained(df, ["s"], "k", 0.9, height=10.0).collect()} == {0, 1}


def test_samples_without_a_partner_are_left_out_first(spark):
    a = spark.createDataFrame([(1, "abcd")], "s int, a string")
    b = spark.createDataFrame([(1, 0, "xbcdx"), (1, 1, "xx"), (2, 0, "abcd")], "s int, m int, b string")
    got = tx.text_overlap_join(a, b, 3, [], ["m"], by=["s"])
    assert [tuple(r) for r in got.collect()] == [(1, 0)]
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_hold_every_gram_once(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("abä😀") for _ in range(k)) for k in (0, 11, 12, 13, 15, 16, 63, 64, 65, 75, 76, 79, 80, 140, 200)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    rows = wd.gram_windows(df, "text", 12, 4, ["k"]).collect()
    assert all(r.core == r.window[3:12] for r in rows)
    got = sorted((r.k, r.window[i : i + 12]) for r in rows for i in range(len(r.window) - 11))
    assert got == sorted((k, t[i : i + 12]) for k, t in enumerate(texts) for i in range(len(t) - 11))
