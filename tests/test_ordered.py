"""Ordered scans with tiny chunks give the same as plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.operators import ordered as od


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for group, size in (("a", 40), ("b", 1), ("c", 9)):
        for pos in range(size):
            data.append((group, pos, None if rng.random() < 0.4 else rng.random()))
    return spark.createDataFrame(data, "g string, pos bigint, v double").repartition(5)


def same(a, b):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.select(*a.columns).collect()), key=key)


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_scan(rows, size):
    got = od.scan(rows, ["g"], "pos", {
        "p": od.before(F.col("v")), "p_in": od.before(F.col("v"), inclusive=True), "n": od.after(F.col("v")),
        "n_in": od.after(F.col("v"), inclusive=True), "m": od.running_max(F.col("v"), inclusive=False), "c": od.running_sum(F.lit(1)),
        "c_ex": od.running_sum(F.lit(1), inclusive=False),
    }, chunk_rows=size)
    w = Window.partitionBy("g").orderBy("pos")
    past, future = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    upto, fromhere = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = rows.select(
        "*", F.last("v", True).over(past).alias("p"), F.last("v", True).over(upto).alias("p_in"), F.first("v", True).over(future).alias("n"),
        F.first("v", True).over(fromhere).alias("n_in"), F.max("v").over(past).alias("m"), F.count(F.lit(1)).over(upto).alias("c"), F.count(F.lit(1)).over(past).alias("c_ex"),
    )
    same(got, want)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_sum_before_is_sum_up_to_predecessor(rows, size):
    out = od.scan(rows, ["g"], "pos", {"to": od.running_sum(F.col("v")), "ex": od.running_sum(F.col("v"), inclusive=False)}, chunk_rows=size)
    w = Window.partitionBy("g").orderBy("pos")
    bad = out.withColumn("prev", F.coalesce(F.lag("to").over(w), F.lit(0.0))).where("prev <> ex").count()
    assert bad == 0


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_neighbours_and_rolling(rows, size):
    w = Window.partitionBy("g").orderBy("pos")
    got = od.neighbours(rows, ["g"], "pos", prev=["v"], nxt=["v"], chunk_rows=size)
    same(got, rows.select("*", F.lag("v").over(w).alias("prev_v"), F.lead("v").over(w).alias("next_v")))
    got = od.rolling(rows, ["g"], "pos", 2, lambda f: {"s": F.count("v").over(f)}, chunk_rows=size)
    same(got, rows.select("*", F.count("v").over(w.rowsBetween(-2, 2)).alias("s")))


@pytest.mark.parametrize("limit", [0, 1000])
def test_positions(rows, limit):
    shuffled = rows.withColumn("k", F.xxhash64("pos"))
    got = od.with_positions(shuffled, ["g"], ["k"], "at", whole_group_rows=limit)
    want = shuffled.withColumn("at", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    same(got.select("g", "pos", "at"), want.select("g", "pos", "at"))
    whole = od.with_positions(shuffled, [], ["g", "k"], "at").select("at").collect()
    assert sorted(r.at for r in whole) == list(range(50))


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_null_groups(spark, size):
    """Rows without a group key are a group: none is lost, and chunks hand on their values."""
    data = [(None if k % 2 else "a", None if k % 4 == 3 else 7, k // 2, float(k)) for k in range(24)]
    rows = spark.createDataFrame(data, "g string, h int, pos bigint, v double")
    for by in (["g"], ["g", "h"]):
        w = Window.partitionBy(*by).orderBy("pos")
        got = od.with_positions(rows, by, ["v"], "at", whole_group_rows=0 if size < 1000 else 1000)
        same(got.select("v", "at"), rows.select("v", (F.row_number().over(w) - 1).alias("at")))
        got = od.scan(rows, by, "pos", {"s": od.running_sum(F.col("v")), "b": od.before(F.col("v"))}, chunk_rows=size)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        same(got.select("v", "s", "b"), rows.select("v", F.sum("v").over(w).alias("s"), F.last("v", True).over(before).alias("b")))
        got = od.neighbours(rows, by, "pos", prev=["v"], reach=4, chunk_rows=size)
        same(got.select("v", "prev_v"), rows.select("v", F.lag("v").over(w).alias("prev_v")))
