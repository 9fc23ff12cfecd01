"""Literal edge cases of single operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import scalars as fn
from pagemill.operators import aggregates as ag
from pagemill.operators import boxes as bx
from pagemill.operators.nearest import nearest
from pagemill.operators import graphs as gr
from pagemill.operators import grids as gd
from pagemill.operators import joins as jn
from pagemill.operators import matching as mt
from pagemill.operators import measures as ms
from pagemill.operators import polylines as pl
from pagemill.operators import progress as pg
from pagemill.operators import sampling as sp
from pagemill.operators import scoring as so
from pagemill.operators import texts as tx
from pagemill.operators import words as wd
from pagemill.sources import linedocs as ld
from pagemill.sources import manifest as mf


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_wkt_round_trip_and_bad_text(spark):
    df = spark.createDataFrame([("LINESTRING (0 1, 2.5 3)",), ("POLYGON ((0 0, 1 0, 1 1, 0 0))",), ("nothing",), (None,)], "w string")
    got = [r.p for r in df.select(ld.wkt_points("w").alias("p")).collect()]
    assert [tuple(p) for p in got[0]] == [(0.0, 1.0), (2.5, 3.0)] and len(got[1]) == 4 and got[2] is None and got[3] is None


def test_scan_manifest_reads_names_only(spark, tmp_path):
    for name in ("a/x.jpg", "a/y.jpg", "b/x.jpg", "b/z.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    df = mf.scan_manifest(spark, str(tmp_path), "*.jpg", {"stem": r"([^/]+)\.jpg$"}).withColumn("key", mf.parent_stem_key(F.col("path")))
    assert rows(df, "stem", "key") == [("x", "a_x"), ("x", "b_x"), ("y", "a_y")]
    assert "content" not in df.columns


def test_width_zero_counts_as_missing(spark):
    line = [(0.0, 0.0), (1.0, 0.0)]
    df = spark.createDataFrame(
        [(1, 0, "p", "text_line", "a", line, 5.0, "t", 0.0), (1, 1, "p", "text_line", "b", line, 5.0, "t", 7.0), (1, 2, "p", "text_line", "c", None, 5.0, "t", 7.0)],
        "d int, n int, image_path string, type string, id string, line array<struct<x:double,y:double>>, width double, text string, width_full double",
    )
    out = ld.scan_line_docs(ld.export_line_docs(df, "d", "n", "full"), "doc")
    assert rows(out, "id", "width") == [("a", 5.0), ("b", 7.0)]


def test_required_counts_fail(spark):
    df = spark.createDataFrame([("train",)], "split string")
    hard = spark.createDataFrame([("train", 2, True)], "split string, expected bigint, hard boolean")
    with pytest.raises(Exception, match="wrong row count for train"):
        mf.require_counts(df, hard).collect()


def test_require_no_leftover(spark):
    lines, feats = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(2, "x")], "k int, v string")
    with pytest.raises(Exception, match="feature without a line"):
        jn.require_no_leftover(lines, feats, ["k"]).collect()


def test_word_pairs_are_strict(spark):
    words = spark.createDataFrame(
        [("touch", 0, 0.0, 10.0), ("touch", 1, 10.0, 10.0), ("overlap", 0, 0.0, 10.0), ("overlap", 1, 8.0, 10.0), ("gap", 0, 0.0, 10.0), ("gap", 1, 22.0, 10.0), ("near", 0, 0.0, 10.0), ("near", 1, 21.9, 10.0)],
        "s string, w int, left double, width double",
    ).withColumn("top", F.lit(3.0)).withColumn("height", F.lit(10.0))
    assert rows(wd.word_pairs(words, ["s"], ["w"]), "s", "a_w", "b_w") == [("near", 0, 1)]


def test_word_pairs_brute_force(spark):
    import random

    rng = random.Random(3)
    data = [(i, rng.uniform(0, 200), rng.uniform(0, 30), rng.uniform(3, 40), rng.choice([4.0, 4.2, 9.0, 10.0, 15.9, 16.1])) for i in range(400)]
    df = spark.createDataFrame([(1, *d) for d in data], "s int, w int, left double, top double, width double, height double")
    want = set()
    for i, l, t, wi, h in data:
        for j, l2, t2, _, h2 in data:
            inter = max(0.0, min(t + h, t2 + h2) - max(t, t2))
            if i != j and 0 < l2 - l - wi < 1.2 * (h + h2) / 2 and inter / (h + h2 - inter) >= 0.9:
                want.add((i, j))
    got = rows(wd.word_pairs(df, ["s"], ["w"]), "a_w", "b_w")
    assert len(got) == len(set(got)) and set(got) == want and want


def test_overlap_pairs_brute_force(spark):
    import random

    rng = random.Random(4)
    make = lambda n: [(i, x := rng.uniform(-50, 50), y := rng.uniform(-50, 50), x + rng.choice([0.5, 3, 20, 70]), y + rng.choice([0.5, 3, 20])) for i in range(n)]
    a, b = make(120), make(150)
    frame = lambda d: spark.createDataFrame([(1, *r) for r in d], "s int, k int, x0 double, y0 double, x1 double, y1 double")
    want = {(i, j) for i, ax0, ay0, ax1, ay1 in a for j, bx0, by0, bx1, by1 in b if min(ax1, bx1) > max(ax0, bx0) and min(ay1, by1) > max(ay0, by0)}
    got = rows(bx.overlap_pairs(bx.sided(frame(a), "a", ["s"], ["k"]), bx.sided(frame(b), "b", ["s"], ["k"]), ["s"]), "a_k", "b_k")
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_with_many_cells(spark, monkeypatch):
    import random

    from pagemill.operators import nearest as nr

    monkeypatch.setattr(nr, "TARGETS_PER_CELL", 4)
    rng = random.Random(6)
    targets = [(1, k, rng.uniform(0, 100), rng.uniform(0, 10)) for k in range(300)]
    queries = [(1, k, rng.uniform(-20, 120), rng.uniform(-5, 15)) for k in range(80)]
    t = spark.createDataFrame(targets, "s int, v int, x double, y double")
    q = spark.createDataFrame(queries, "s int, p int, x double, y double")
    got = dict(rows(pl.nearest_vertex(q, t, ["s"], ["p"], ["v"]), "p", "v"))
    for _, p, x, y in queries:
        assert got[p] == min(targets, key=lambda r: (math.hypot(r[2] - x, r[3] - y), r[1]))[1]


def test_suppress_drops_piles_of_copies(spark):
    df = spark.createDataFrame([(1, k, 0.0, 0.0, 2.0, 2.0, 0.5, "a") for k in range(200)] + [(1, 999, 0.1, 0.0, 2.1, 2.0, 0.9, "a"), (1, 1000, 9.0, 9.0, 10.0, 10.0, 0.1, "a")],
                               "s int, b int, x0 double, y0 double, x1 double, y1 double, score double, category string")
    assert rows(bx.suppress_boxes(df, ["s"], "b", 0.5), "b") == [(999,), (1000,)]


def test_suppress_invariants(spark):
    import random

    rng = random.Random(8)
    data = [(1, k, x := rng.uniform(0, 20), y := rng.uniform(0, 20), x + 4, y + 4, rng.random(), "a") for k in range(120)]
    df = spark.createDataFrame(data, "s int, b int, x0 double, y0 double, x1 double, y1 double, score double, category string")
    kept = {r[0] for r in rows(bx.suppress_boxes(df, ["s"], "b", 0.3), "b")}

    def iou(p, q):
        inter = max(0, min(p[4], q[4]) - max(p[2], q[2])) * max(0, min(p[5], q[5]) - max(p[3], q[3]))
        return inter / (32 - inter)

    alive = []
    for r in sorted(data, key=lambda r: (-r[6], r[1])):
        if all(iou(r, k) <= 0.3 for k in alive):
            alive.append(r)
    assert kept == {r[1] for r in alive}


def test_components_chain_star_and_lone(spark):
    chain = [(k, k + 1) for k in range(300)]
    edges = spark.createDataFrame(chain + [(1000, k) for k in range(1001, 1040)], "a bigint, b bigint").repartition(7)
    nodes = spark.createDataFrame([(k,) for k in [*range(301), *range(1000, 1040), 5000]], "id bigint")
    labels = dict(rows(gr.components(nodes, edges), "id", "component"))
    assert all(labels[k] == 0 for k in range(301)) and all(labels[k] == 1000 for k in range(1000, 1040)) and labels[5000] == 5000


def test_longest_path_drops_cycles(spark):
    tree = [(1, 2), (2, 3), (3, 4), (3, 5), (5, 6)]
    edges = spark.createDataFrame(tree + [(10, 11), (11, 12), (12, 10)], "a bigint, b bigint")
    out = gr.longest_path(edges)
    path = rows(out, "component", "step", "node", "length")
    assert [p[2] for p in path] in ([1, 2, 3, 5, 6], [6, 5, 3, 2, 1]) and {p[0] for p in path} == {1} and {p[3] for p in path} == {4}


def test_eliminate_like_sequential(spark):
    import random

    rng = random.Random(2)
    ys = [rng.uniform(-3, 3) + k * 0.5 for k in range(40)]
    df = spark.createDataFrame([(1, k, float(k), y) for k, y in enumerate(ys)], "g int, seq int, x double, y double")
    bad = lambda p, q: 0 if p is None or q is None else int(not -1 <= (q[1] - p[1]) / (q[0] - p[0]) <= 2)
    live = [(k, y) for k, y in enumerate(ys)]
    while True:
        at = lambda i: live[i] if 0 <= i < len(live) else None
        gains = [bad(at(i - 1), at(i)) + bad(at(i), at(i + 1)) - bad(at(i - 1), at(i + 1)) for i in range(len(live))]
        best = max(gains)
        if best <= 0:
            break
        live.pop(gains.index(best))
    assert [r[0] for r in rows(gr.eliminate(df, ["g"], -1.0, 2.0), "seq")] == [k for k, _ in live]


def test_mutual_best_ties_and_greedy(spark):
    df = spark.createDataFrame([(1, i, j, 0.5) for i in (1, 2) for j in (3, 4)], "b int, i bigint, j bigint, score double")
    assert rows(mt.mutual_best(df, ["b"]), "i", "j") == [(1, 3)]
    assert rows(mt.greedy_pairs(df, ["b"]), "i", "j") == [(1, 3), (2, 4)]


def test_greedy_matches_sequential(spark):
    import random

    rng = random.Random(1)
    data = [(1, i, j, round(rng.random(), 2)) for i in range(12) for j in range(10) if rng.random() < 0.6]
    used_i, used_j, want = set(), set(), []
    for _, i, j, s in sorted(data, key=lambda r: (-r[3], r[1], r[2])):
        if i not in used_i and j not in used_j:
            want.append((i, j))
            used_i.add(i)
            used_j.add(j)
    for parts in (1, 16):
        df = spark.createDataFrame(data, "b int, i bigint, j bigint, score double").repartition(parts)
        assert rows(mt.greedy_pairs(df, ["b"]), "i", "j") == sorted(want)


def test_text_overlap_needs_three(spark):
    a = spark.createDataFrame([(1, "abX"), (2, "abcX"), (3, None), (4, "")], "k int, a string")
    b = spark.createDataFrame([(7, "abY"), (8, "abcY"), (9, None)], "m int, b string")
    assert rows(tx.text_overlap_join(a, b, 3, ["k"], ["m"]), "k", "m") == [(2, 8)]
    assert rows(tx.lcs_align(a, b, 3, ["k"], ["m"]), "k", "m", "i", "j", "length") == [(2, 8, 0, 0, 3)]


def test_gram_join_without_broadcast_and_long_accented_text(spark):
    long = "é" * 5 + "ä b c d" * 100 + "needle in hay" + "ü" * 200
    a = spark.createDataFrame([(1, "xx needle in hay yy"), (2, "zzzz")], "k int, a string")
    b = spark.createDataFrame([(7, long)], "m int, b string")
    want = [(1, 7, 3, long.index("needle"), 13)]
    assert rows(tx.lcs_align(a, b, 6, ["k"], ["m"]), "k", "m", "i", "j", "length") == want
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert rows(tx.lcs_align(a, b, 6, ["k"], ["m"]), "k", "m", "i", "j", "length") == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_error_rate_of_empty_truth(spark):
    df = spark.createDataFrame([("", "a"), ("", ""), ("ab", "b")], "t string, f string")
    assert [tuple(r) for r in tx.text_errors(df, "t", "f").select("distance", "cer").collect()] == [(1, None), (0, None), (1, 0.5)]


def test_classify_matches(spark):
    df = spark.createDataFrame(
        [(1, "abcd", "xabcy", -0.5), (2, "abcd", "xyz", -0.5), (3, None, "abc", -0.5), (4, None, None, -0.5), (5, "abc", "abc", -1.5)],
        "k int, a string, b string, log_assignment double",
    )
    assert rows(mt.classify_matches(df), "k", "status") == [(1, "kept"), (2, "removed"), (3, "removed"), (4, "kept")]


def test_ignored_labels_only(spark):
    df = spark.createDataFrame([(0, 255), (1, 255)], "pred int, gt int")
    assert rows(ag.class_iou(df, 2), "class", "iou") == [(-2, 0.0), (-1, 0.0), (0, 0.0), (1, 0.0)]


def test_runs_of_full_empty_and_leading_masks(spark):
    masks = {"clear": [0, 0, 0, 0], "full": [1, 1, 1, 1], "lead": [1, 0, 0, 1]}
    df = spark.createDataFrame([(m, k % 2, k // 2, v) for m, vals in masks.items() for k, v in enumerate(vals)], "sample string, y int, x int, value int")
    packed = gd.rle_pack(gd.rle_encode(df))
    assert dict(rows(packed, "sample", "counts")) == {"clear": [4], "full": [0, 4], "lead": [0, 1, 2, 1]}
    assert dict(rows(packed.select("sample", gd.rle_area("counts").alias("a")), "sample", "a")) == {"clear": 0, "full": 4, "lead": 2}
    back = gd.rle_decode(gd.rle_unpack(packed), packed.select("sample", F.lit(2).alias("h")))
    assert rows(back, *df.columns) == rows(df, *df.columns)
    assert rows(gd.mask_boxes(df.where("value = 1"), df, ["sample"]), "sample", "x1", "y1") == [("clear", 0, 0), ("full", 1, 1), ("lead", 1, 1)]


def test_fit_line_with_constant_x(spark):
    df = spark.createDataFrame([("v", 5.0, 1.0), ("v", 5.0, 3.0)], "line_id string, x double, y double")
    assert rows(ms.fit_line(df, ["line_id"]), "slope", "y0", "y1") == [(0.0, 2.0, 2.0)]


def test_short_lines(spark):
    df = spark.createDataFrame([("one", 0, 1.0, 1.0), ("same", 0, 1.0, 1.0), ("same", 1, 1.0, 1.0), ("two", 0, 0.0, 0.0), ("two", 1, 4.0, 0.0)], "line_id string, seq int, x double, y double")
    assert rows(pl.interpolate_line(df, 3), "line_id", "k", "x") == [("two", 0, 0.0), ("two", 1, 2.0), ("two", 2, 4.0)]
    assert rows(pl.filter_by_length(df, 0.0), "line_id") == [("two",)]
    assert rows(pl.extend_line(df, 1.0).where("line_id = 'two'"), "seq", "x") == [(-1, -1.0), (0, 0.0), (1, 4.0), (2, 5.0)]
    cuts = spark.createDataFrame([("two", 1.0, 3.0), ("one", 0.0, 1.0)], "line_id string, a double, b double")
    assert rows(pl.substring_line(df, cuts), "line_id", "d", "x") == [("two", 1.0, 1.0), ("two", 3.0, 3.0)]


def test_clean_lines(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 0, 0.5, nan), ("a", 1, 0.5, 0.5), ("b", 0, -1.0, 2.0), ("c", 0, None, 0.1)], "line_id string, seq int, x double, y double")
    assert rows(pl.clean_lines(df), "line_id", "x", "y") == [("b", 0.0, 1.0)]


def test_densify_repeated_x(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("a", 3.0, 6.0), ("a", 1.0, 9.0), ("a", 1.0, 8.0), ("b", 2.0, 5.0)], "line_id string, x double, y double")
    assert rows(pl.densify(df), "line_id", "x", "y") == [("a", 0, 0), ("a", 1, 2), ("a", 2, 4), ("a", 3, 6), ("b", 2, 5)]


def test_asset_log(spark):
    logs = {"x": ["remove", "create"], "y": ["update", "update"], "z": ["create", "remove", "create", "update", "update"]}
    df = spark.createDataFrame([(a, k, v) for a, acts in logs.items() for k, v in enumerate(acts)], "asset string, seq bigint, action string")
    got = {(a, k): v for a, k, v in (tuple(r) for r in pg.assets_as_of(df).select("asset", "seq", "version").collect())}
    assert [got["x", k] for k in range(2)] == [None, None] and [got["y", k] for k in range(2)] == [None, None]
    assert [got["z", k] for k in range(5)] == [None, 0, None, 2, 3]


@pytest.mark.parametrize("fold", [1, 3, 1024])
def test_monotone_accept(spark, fold):
    import random

    rng = random.Random(9)
    ys = [rng.uniform(0, 30) for _ in range(60)]
    df = spark.createDataFrame([(1, k, float(k), y) for k, y in enumerate(ys)], "g int, seq int, x double, y double")
    want, last = [0], (0, ys[0])
    for k in range(1, 60):
        if -1 <= (ys[k] - last[1]) / (k - last[0]) <= 1:
            want.append(k)
            last = (k, ys[k])
    assert [r[0] for r in rows(pg.monotone_accept(df, ["g"], -1.0, 1.0, fold_rows=fold), "seq")] == want


def test_fill_nearest_far_holes(spark):
    known = {(0, 0): 1.0, (9, 9): 2.0}
    df = spark.createDataFrame([(1, y, x, known.get((y, x))) for y in range(10) for x in range(10)], "sample int, y int, x int, value double")
    got = {(y, x): v for y, x, v in rows(gd.fill_nearest(df), "y", "x", "value")}
    for y in range(10):
        for x in range(10):
            want = min(known, key=lambda c: ((c[0] - y) ** 2 + (c[1] - x) ** 2, c))
            assert got[y, x] == known[want]


def test_fill_grid_stops_without_values(spark):
    df = spark.createDataFrame([(1, y, x, 0.5 if (y, x) == (0, 0) else None) for y in range(2) for x in range(2)], "sample int, y int, x int, value double")
    assert gd.fill_grid(df).where("value IS NULL").count() == 3


def test_thin_boxes_have_few_candidates(spark):
    """Stacked text lines: long, thin, and no two of them overlap."""
    lines = spark.range(2000).select(F.lit(1).alias("s"), "id", F.lit(0.0).alias("x0"), (F.col("id") * 12.0).alias("y0"), F.lit(900.0).alias("x1"), (F.col("id") * 12.0 + 10).alias("y1"))
    words = spark.range(2000).select(F.lit(1).alias("s"), "id", (F.col("id") % 50 * 18.0).alias("x0"), F.floor(F.col("id") / 50).alias("r")).select("s", "id", "x0", (F.col("r") * 12.0 + 1).alias("y0"), (F.col("x0") + 15).alias("x1"), (F.col("r") * 12.0 + 9).alias("y1"))
    a, b = bx.sided(lines, "a", ["s"], ["id"]), bx.sided(words, "b", ["s"], ["id"])
    assert bx.overlap_candidates(a, bx.sided(lines, "b", ["s"], ["id"]), ["s"]).count() <= 20_000
    assert bx.overlap_pairs(a, bx.sided(lines, "b", ["s"], ["id"]), ["s"]).where("a_id <> b_id").count() == 0
    assert bx.overlap_candidates(a, b, ["s"]).count() <= 20_000
    assert rows(bx.overlap_pairs(a, b, ["s"]), "a_id", "b_id") == sorted((k // 50, k) for k in range(2000))


def test_nearest_with_an_outlier(spark):
    """One far target does not put all others into one cell; copies of a point are one cell."""
    import random

    draw = random.Random(6)
    points = [(float(draw.randrange(1000)), float(draw.randrange(1000))) for _ in range(3000)] + [(1e9, 1e9)] + [(5.0, 5.0)] * 1200
    asked = [(draw.uniform(-50, 1100), draw.uniform(-50, 1100)) for _ in range(60)] + [(2e9, 0.0), (-1e6, 3.0)]
    side = lambda data, p: spark.createDataFrame([(1, k, x, y, x, y) for k, (x, y) in enumerate(data)], ", ".join(["s int", f"{p or 't'}_id int", *[f"{p}{c} double" for c in ("x0", "y0", "x1", "y1")]]))
    got = {r.q_id: (r.t_id, r.distance) for r in nearest(side(asked, "q"), side(points, ""), ["s"], ["q_id"], ["t_id"]).collect()}
    for k, (x, y) in enumerate(asked):
        d, t = min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, i) for i, (a, b) in enumerate(points))
        assert got[k][1] == pytest.approx(d) and (got[k][0] == t or got[k][1] == pytest.approx(d))


def test_sampling_is_stable(spark):
    df = spark.createDataFrame([(g, k) for g in range(3) for k in range(25)], "g int, k int")
    outs = [rows(sp.subsample_pairs(df.repartition(p), ["g"], "k", 20, 0.666, 7)[0], "g", "k", "role") for p in (1, 16)]
    drawn, few = sp.subsample_pairs(df.where("g > 0 OR k < 5"), ["g"], "k", 20, 0.666, 7)
    assert rows(few, "g", "available") == [(0, 5)] and drawn.where("g = 0").count() == 0
    assert outs[0] == outs[1]
    roles = [r for g, _, r in outs[0] if g == 0]
    assert (roles.count("pair"), roles.count("a"), roles.count("b")) == (15, 5, 5)
    text = spark.createDataFrame([(1, "some text to change " * 20)], "k int, t string")
    noisy = text.select(sp.mutate_text("t", ["k"], 0.05, "xyz", 3).alias("t")).first().t
    same = text.select(sp.mutate_text("t", ["k"], 0.0, "xyz", 3).alias("t")).first().t
    assert noisy != text.first().t and same == text.first().t and 340 < len(noisy) < 460
    assert rows(sp.shuffle(df, ["g"], ["k"], 5), "g", "rank") == sorted((g, k) for g in range(3) for k in range(25))


def test_distractor_counts(spark):
    points = spark.createDataFrame([("s", f"l{k}", q, float(q), float(k)) for k in range(5) for q in range(3)], "s string, line_id string, seq int, x double, y double")
    lines = spark.createDataFrame([("s", f"l{k}", 2.0 if k % 2 else None) for k in range(5)], "s string, line_id string, width double")
    out = sp.add_distractors(points.drop("s"), lines, ["s"], 0.5, 3)
    assert out.select("line_id").distinct().count() == 2 and out.count() == 202


def test_scoring_errors_and_series(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 0.0)], "k bigint, v double")
    done = so.map_rows(df, lambda r, top: {"q": top / r["v"]}, "k", "q double", top=4.0)
    assert rows(done.where("error IS NULL"), "k", "q") == [(1, 2.0)] and rows(done.where("error IS NOT NULL"), "k")[0][0] == 2
    gt = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 2.0), ("b", 0.0, 1.0)], "g string, x double, y double")
    score = dict(rows(ms.series_f1(gt.where("g = 'a'"), gt, ["g"]), "g", "f1"))
    assert score == {"a": 1.0, "b": 0.0}


def test_series_set_modes(spark):
    gt = spark.createDataFrame([("s", k, float(x), float(10 * k + x)) for k in range(2) for x in range(5)], "g string, series int, x double, y double")
    pred = gt.unionByName(gt.where("series = 0").withColumn("series", F.lit(7)).withColumn("y", F.col("y") + 500))
    assert [tuple(round(v, 6) for v in r) for r in rows(ms.series_set_score(pred, gt, ["g"]), "score_6a", "score_6b")] == [(1.0, round(2 / 3, 6))]


def test_border_and_length_predicates(spark):
    df = spark.createDataFrame([([(0.01, 0.2), (0.02, 0.9)],), ([(0.01, 0.2), (0.5, 0.9)],)], "p array<struct<x:double,y:double>>")
    got = df.select(fn.is_border("p", 0.05).alias("b"), fn.is_horizontal("p").alias("h")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False)]


def staged_names(monkeypatch, *modules):
    """Names of the tables written while the test runs."""
    names = []
    for module in modules:
        monkeypatch.setattr(module, "staged", lambda df, name="stage", write=module.staged: (names.append(name), write(df, name))[1])
    return names


def plain_similarity(a, b):
    """``(a, b, similarity)`` of boxes ``{id: (x0, y0, x1, y1)}`` of one group."""
    out = set()
    for i, p in a.items():
        over = {j: max(0, min(p[2], q[2]) - max(p[0], q[0])) * max(0, min(p[3], q[3]) - max(p[1], q[1])) for j, q in b.items()}
        area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
        hits = {(i, j, round(o / (area(p) + area(b[j]) - o), 9)) for j, o in over.items() if o > 0}
        gap = lambda q: math.hypot(max(0, q[0] - p[2], p[0] - q[2]), max(0, q[1] - p[3], p[1] - q[3]))  # noqa: B023, E731
        near = min((gap(q), j) for j, q in b.items())
        out |= hits or {(i, near[1], round(-near[0] + 0.0, 9))}
    return out


@pytest.mark.parametrize("sizes", [(5, 9, 30), (5, 90, 9)])
def test_similarity_in_small_and_large_groups(spark, monkeypatch, sizes):
    from pagemill.operators import boxes, nearest, ordered

    draw = random.Random(sum(sizes))
    sides = [[], []]
    for g, size in enumerate(sizes):
        for side in sides:
            for k in range(size):
                x, y = draw.randint(0, 60), draw.randint(0, 60)
                side.append((g, k, float(x), float(y), float(x + draw.randint(1, 9)), float(y + draw.randint(1, 9))))
    frames = [spark.createDataFrame(side, "g int, k int, x0 double, y0 double, x1 double, y1 double") for side in sides]
    names = staged_names(monkeypatch, boxes, nearest, ordered)
    got = boxes.box_similarity(*frames, ["g"], "k").collect()
    # groups that are small take one join: but for the keys of large groups nothing is written
    assert set(names) == {"large"} if max(sizes) <= nearest.GROUP_TARGETS else {"large", "similar", "left", "right"} <= set(names)
    for g in range(3):
        a, b = [{r[1]: r[2:] for r in side if r[0] == g} for side in sides]
        rows = [r for r in got if r.g == g]
        assert {(r.a_k, r.b_k, round(r.similarity, 9)) for r in rows} == plain_similarity(a, b) and len(rows) == len(plain_similarity(a, b))


@pytest.mark.parametrize("size", [12, 260])
def test_suppress_in_small_and_large_groups(spark, monkeypatch, size):
    from pagemill.operators import boxes, folds, graphs, ordered

    draw = random.Random(size)
    data = []
    for s in (1, 2):
        for k in range(size if s == 1 else 12):
            x, y = draw.randint(0, 25), draw.randint(0, 6)
            data.append((s, k, float(x), float(y), x + 10.0, y + 10.0, draw.randint(0, 4) / 10, draw.choice(["a", "b", None])))
    df = spark.createDataFrame(data, "s int, k int, x0 double, y0 double, x1 double, y1 double, score double, category string")
    names = staged_names(monkeypatch, boxes, folds, graphs, ordered)
    got = rows(bx.suppress_boxes(df, ["s"], "k", 0.5), "s", "k")
    assert set(names) == {"large"} if size == 12 else {"large", "boxes", "rivals"} <= set(names)

    def drops(a, b):
        inter = max(0, 10 - abs(a[2] - b[2])) * max(0, 10 - abs(a[3] - b[3]))
        return a[0] == b[0] and a[7] == b[7] is not None and inter > 0.5 * (200 - inter)

    kept = []
    for r in sorted(data, key=lambda r: (-r[6], r[1])):
        if not any(drops(k, r) for k in kept):
            kept.append(r)
    assert got == sorted(r[:2] for r in kept)


def test_blends_of_whole_short_long_and_empty_lines(spark, monkeypatch):
    """Points come as plain columns, and a column that is not asked for is not made."""
    monkeypatch.setattr(pl, "LINE_POINTS", 4)
    a = [("p", k, float(k), 0.0) for k in range(3)] + [("q", k, 1.0, 1.0) for k in range(3)] + [("r", k, float(k), float(k)) for k in range(9)] + [("s", 0, 1.0, 1.0)]
    b = [(line, k, x + 2.0, y + 4.0) for line, k, x, y in a]
    frame = lambda d: spark.createDataFrame(d, "line_id string, seq int, x double, y double")
    out = pl.blend_lines(frame(a), frame(b), 0.5, 5)
    got = {(r.line_id, r.k): (round(r.x, 9), round(r.y, 9)) for r in out.collect()}
    assert got == {("p", k): (k / 2 + 1, 2.0) for k in range(5)} | {("r", k): (2.0 * k + 1, 2.0 * k + 2) for k in range(5)}
    counted = out.groupBy("line_id").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in counted and "inline" not in counted


def test_places_on_short_and_long_lines(spark, monkeypatch):
    """Lines of few points take no scan and no written table; gaps of numbers part a line, and both ways give the same segments."""
    from pagemill.operators import nearest as nr
    from pagemill.operators import ordered

    draw = random.Random(11)
    data = [(f"l{g}", k, draw.uniform(0, 9), draw.uniform(0, 9)) for g in range(6) for k in range(g * 3)] + [("gap", k, float(k), None if k == 9 else 0.0) for k in (0, 1, 4, 5, 8, 9)]
    df = spark.createDataFrame(data, "line_id string, seq int, x double, y double")
    names = staged_names(monkeypatch, pl, nr, ordered)
    got = sorted(map(str, pl.segments(df).collect()))
    asked = df.select("line_id", F.col("seq").alias("p"), (F.col("x") + 1).alias("x"), F.col("y")).where("y IS NOT NULL")
    found = {(r.line_id, r.p): (r.segment, round(r.distance, 9)) for r in pl.locate_along(asked, df.where("line_id <> 'gap'"), ["p"]).collect()}
    assert set(names) == {"large"} and len([r for r in got if "gap" in r]) == 3
    by_line = {}
    for line, k, x, y in data:
        by_line.setdefault(line, []).append((x, y))

    def gap(p, a, b):
        d = (b[0] - a[0], b[1] - a[1])
        t = max(0, min(1, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / (d[0] ** 2 + d[1] ** 2)))
        return math.hypot(p[0] - a[0] - d[0] * t, p[1] - a[1] - d[1] * t)

    for line, k, x, y in data:
        if line != "gap":
            pts = by_line[line]
            assert found[(line, k)][1] == round(min(gap((x + 1, y), a, b) for a, b in zip(pts, pts[1:], strict=False)), 9)
    monkeypatch.setattr(pl, "CHUNK_ROWS", 4)
    assert sorted(map(str, pl.segments(df).collect())) == got and "points" in names


def test_annotations_that_lie_by_image_are_not_sorted_as_a_whole(spark, monkeypatch):
    """Only images and categories are written to be numbered; annotations without a category take no id."""
    from pyspark.sql import Window

    from pagemill.operators import ordered

    names = []
    monkeypatch.setattr(ordered, "staged", lambda df, name="stage", write=ordered.staged: (names.append(df.columns), write(df, name))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        data = [(i, k, "ab"[(i + k) % 2]) for i in range(30) for k in range(3)]
        data.append((3, -1, None))
        by_image = spark.createDataFrame(data, "image long, k int, category string").withColumn("n", F.row_number().over(Window.partitionBy("image").orderBy("k")))
        boxes = by_image.select("image", "n", "category", F.struct(F.lit(1.0).alias("x")).alias("bbox"), F.lit(1.0).alias("area"))
        images = boxes.select("image").distinct().union(spark.createDataFrame([(-5,)], "image long")).where("image <> -5")
        made = ag.coco_records(images, boxes, ["n"])["annotations"]
        got = sorted((r.id, r.image, r.image_id, r.category_id) for r in made.collect())
        assert got == [(j, i, i, (i + k) % 2) for j, (i, k, _) in enumerate(data[:-1])]
        assert len(names) == 2 and all("bbox" not in columns for columns in names)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
