"""Seeded draws of whole batches against the same draws one by one."""

import random
import string

from pyspark.sql import functions as F

from pagemill.operators import polylines as pl
from pagemill.operators import sampling as sp

TEXTS = [(1, "plain words"), (2, ""), (3, None), (4, "ä😀 ß\u0000x"), (5, "a" * 300), (6, " "), (-7, "e" * 40)]


def one_by_one(spark, rate, alphabet, seed):
    """Character by character, by ``uniform``."""
    out = {}
    for k, text in TEXTS:
        longest = 2 * len(text or "") + 2
        steps = ("insert", "insert letter", "delete", "substitute", "substitute letter")
        draws = spark.range(longest).select(*[sp.uniform(seed, F.lit(k), F.lit(s), F.col("id").cast("int")) for s in steps]).collect()
        pick = lambda s, i: alphabet[int(draws[i][s] * len(alphabet))]  # noqa: B023, E731
        if text is not None:
            text = "".join((pick(1, i) if draws[i][0] <= rate else "") + c for i, c in enumerate(text + " "))[:-1]
            text = "".join(c for i, c in enumerate(text) if draws[i][2] > rate)
            text = "".join(pick(4, i) if draws[i][3] <= rate else c for i, c in enumerate(text))
        out[k] = text
    return out


def test_mutate_text_draws(spark):
    df = spark.createDataFrame(TEXTS, "k int, t string").coalesce(1)
    for rate in (0.3, 0.0, 1.0, -1.0):
        got = {r.k: r.m for r in df.select("k", sp.mutate_text("t", ["k"], rate, string.ascii_letters, 3).alias("m")).collect()}
        assert got == one_by_one(spark, rate, string.ascii_letters, 3)
    assert got == dict(TEXTS)


def test_mutate_text_does_a_batch_at_once(spark):
    df = spark.createDataFrame(TEXTS, "k int, t string")
    plan = df.select(sp.mutate_text("t", ["k"], 0.3, "xyz", 3))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_blended_lines_are_mixed_points(spark, monkeypatch):
    """Lines as wholes, long ones too, give the points of ``interpolate_line``; lines of length 0 give none."""
    draw = random.Random(4)
    data = [(f"l{k}", q, float(draw.randrange(9)), draw.random()) for k in range(30) for q in range(1 + k % 7)]
    data += [("still", 0, 1.0, 1.0), ("still", 1, 1.0, 1.0)]
    a = spark.createDataFrame(data, "line_id string, seq int, x double, y double")
    b = a.withColumn("y", F.col("y") * 2)
    left, right = ({(r.line_id, r.k): (r.x, r.y) for r in pl.interpolate_line(d, 11).collect()} for d in (a, b))
    want = {k: tuple(0.7 * p + 0.3 * q for p, q in zip(v, right[k])) for k, v in left.items()}
    for most in (4096, 4):
        monkeypatch.setattr(pl, "LINE_POINTS", most)
        got = {(r.line_id, r.k): (r.x, r.y) for r in pl.blend_lines(a, b, 0.3, 11).collect()}
        assert got.keys() == want.keys() and all(abs(p - q) < 1e-12 for k in got for p, q in zip(got[k], want[k]))


def test_blends_join_lines_not_points(spark):
    points = spark.createDataFrame([("s", 0, 0.0, 0.0), ("s", 1, 1.0, 0.0)], "line_id string, seq int, x double, y double")
    plan = pl.blend_lines(points, points, 0.3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Join") and "Window" not in plan
