"""Polylines, series, logs, metrics, training sets, scoring and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from pagemill.functions import scalars as fn
from pagemill.operators import aggregates as ag
from pagemill.operators import boxes as bx
from pagemill.operators import graphs as gr
from pagemill.operators import joins as jn
from pagemill.operators import matching as mt
from pagemill.operators import measures as ms
from pagemill.operators import polylines as pl
from pagemill.operators import progress as pg
from pagemill.operators import sampling as sp
from pagemill.operators import scoring as so
from pagemill.operators.ordered import with_positions
from pagemill.plans.registry import query, r6
from pagemill.session import new_folder
from pagemill.streaming import incremental as st

# ---- aggregates


@query("a01_run_summary", "", "SELECT unnest(['p_size', 'p_retailprice']) AS metric, unnest([round(avg(p_size), 6), round(avg(p_retailprice), 6)]) AS mean FROM part")
def _(t):
    return ag.summarize(t.part.select("p_size", "p_retailprice")).select("metric", r6("mean").alias("mean"))


@query(
    "a02_score_by_type", "",
    "SELECT p_type, round(avg(p_retailprice), 6) AS mean, count(*) AS n, grouping(p_type) = 1 AS overall FROM part GROUP BY GROUPING SETS ((p_type), ())",
)
def _(t):
    return ag.score_by_type(t.part, "p_type", "p_retailprice").select("p_type", r6("mean").alias("mean"), "n", "overall")


@query("a03_channel_stats", "v_series", "SELECT pos, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM v_series GROUP BY pos")
def _(t):
    return ag.channel_stats(t.series, "pos", "value").select("pos", r6("mean").alias("mean"), r6("std").alias("std"), "n")


@query(
    "a04_having_min", "v_textlines",
    """SELECT doc_id FROM v_textlines GROUP BY doc_id HAVING count(DISTINCT line_no) >= 20 AND count(DISTINCT line_no) FILTER (length(text) > 60) >= 20""",
)
def _(t):
    return ag.having_min(t.textlines, t.textlines.where(F.length("text") > 60), "doc_id", "line_no", 20)


@query(
    "a07_to_coco", "v_boxes",
    """c AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS category_id FROM (SELECT DISTINCT category FROM v_boxes)),
    i AS (SELECT sample, row_number() OVER (ORDER BY sample) - 1 AS image_id FROM (SELECT DISTINCT sample FROM v_boxes))
    SELECT b.sample, image_id, row_number() OVER (ORDER BY b.sample, box_id) - 1 AS id, category_id, x0, x1 - x0 AS w, (x1 - x0) * (y1 - y0) AS area
    FROM v_boxes b JOIN c ON b.category = c.category JOIN i ON i.sample = b.sample""",
)
def _(t):
    box = fn.box_xywh("x0", "y0", "x1", "y1")
    annotations = t.boxes.select(F.col("sample").alias("image"), "box_id", "category", box.alias("bbox"), (box["w"] * box["h"]).alias("area"))
    rows = ag.coco_records(annotations.select("image").distinct(), annotations, ["box_id"])["annotations"]
    return rows.select(F.col("image").alias("sample"), "image_id", "id", "category_id", F.col("bbox.x").alias("x0"), F.col("bbox.w").alias("w"), "area")


@query(
    "a07_coco_sink", "v_boxes",
    """SELECT 'images' AS kind, count(DISTINCT sample) AS n, count(DISTINCT sample) - 1 AS last_id FROM v_boxes
    UNION ALL SELECT 'annotations', count(*), count(*) - 1 FROM v_boxes
    UNION ALL SELECT 'categories', count(DISTINCT category), count(DISTINCT category) - 1 FROM v_boxes""",
)
def _(t):
    box = fn.box_xywh("x0", "y0", "x1", "y1")
    annotations = t.boxes.select(F.col("sample").alias("image"), "box_id", "category", box.alias("bbox"), (box["w"] * box["h"]).alias("area"))
    folder = new_folder(t.spark, "coco")
    ag.write_coco(ag.coco_records(annotations.select("image").distinct(), annotations, ["box_id"]), folder)
    ids = {"images": "image_id", "annotations": "id", "categories": "id"}
    kinds = [t.spark.read.schema(f"{c} long").json(f"{folder}/{k}").agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"), F.max(c).alias("last_id")) for k, c in ids.items()]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


IOU_BASE = """k AS (SELECT CAST(c AS INT) AS class, count(*) FILTER (pred = c) AS p, count(*) FILTER (gt = c) AS t, count(*) FILTER (pred = c AND gt = c) AS tp
      FROM v_class, range(2) r(c) WHERE gt <> 255 GROUP BY c),
    s AS (SELECT class, tp / (t + p - tp + 1e-10) * 100 AS iou, (p - tp) / (t + p - tp + 1e-10) AS fp_ratio, (t - tp) / (t + p - tp + 1e-10) AS fn_ratio FROM k)"""
IOU_COLUMNS = "SELECT class, round(iou, 6) AS iou, round(fp_ratio, 6) AS fp_ratio, round(fn_ratio, 6) AS fn_ratio"


@query(
    "a08_class_iou", "v_class",
    f"""{IOU_BASE}, z AS (SELECT * FROM s UNION ALL SELECT -1, avg(iou), avg(fp_ratio), avg(fn_ratio) FROM s
      UNION ALL SELECT -2, avg(iou), avg(fp_ratio), avg(fn_ratio) FROM s WHERE class > 0) {IOU_COLUMNS} FROM z""",
)
def _(t):
    return ag.class_iou(t.classes, 2).select("class", *[r6(c).alias(c) for c in ("iou", "fp_ratio", "fn_ratio")])


@query(
    "a11_fit_line", "v_poly",
    """f AS (SELECT line_id, CASE WHEN var_pop(x) > 0 THEN regr_slope(y, x) ELSE 0 END AS m, CASE WHEN var_pop(x) > 0 THEN regr_intercept(y, x) ELSE avg(y) END AS b, min(x) AS x0, max(x) AS x1 FROM v_poly GROUP BY line_id)
    SELECT line_id, round(m, 4) + 0.0 AS slope, round(x0, 6) AS x0, round(b + m * x0, 4) + 0.0 AS y0, round(x1, 6) AS x1, round(b + m * x1, 4) + 0.0 AS y1 FROM f""",
)
def _(t):
    fit = ms.fit_line(t.poly, ["line_id"])
    r4 = lambda c: F.round(c, 4) + F.lit(0.0)
    return fit.select("line_id", r4("slope").alias("slope"), r6("x0").alias("x0"), r4("y0").alias("y0"), r6("x1").alias("x1"), r4("y1").alias("y1"))


SEGS = """g AS (SELECT line_id, type, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM v_poly WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
    h AS (SELECT line_id, type, dx, dy, sqrt(dx * dx + dy * dy) AS len FROM g WHERE dx IS NOT NULL)"""


def typed_segments(t):
    types = t.poly.groupBy("line_id").agg(F.first("type").alias("type"))
    return pl.segments(t.poly).join(types, "line_id")


@query(
    "a12_alignment_score", "v_poly",
    f"""{SEGS} SELECT line_id, round(sum((CASE WHEN type = 'text_line' THEN acos(least(1, abs(dx) / len)) ELSE least(acos(least(1, abs(dx) / len)), acos(least(1, abs(dy) / len))) END * len) ** 2), 3) + 0.0 AS score
    FROM h WHERE len > 0 GROUP BY line_id""",
)
def _(t):
    return ms.alignment_score(typed_segments(t), ["line_id"]).select("line_id", (F.round("score", 3) + 0.0).alias("score"))


@query(
    "a13_best_angle", "v_poly",
    f"""{SEGS}, a AS (SELECT k, -pi() / 2 + pi() * k / 99 AS a FROM range(100) r(k)),
    r AS (SELECT line_id, type, k, len, dx * cos(a) - dy * sin(a) AS dx, dx * sin(a) + dy * cos(a) AS dy FROM h, a WHERE len > 0),
    s AS (SELECT line_id, k, round(sum((CASE WHEN type = 'text_line' THEN acos(least(1, abs(dx) / sqrt(dx * dx + dy * dy))) ELSE least(acos(least(1, abs(dx) / sqrt(dx * dx + dy * dy))), acos(least(1, abs(dy) / sqrt(dx * dx + dy * dy)))) END * len) ** 2), 6) AS score FROM r GROUP BY line_id, k)
    SELECT line_id, round(score, 3) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY score, k) AS n FROM s) WHERE n = 1""",
)
def _(t):
    return ms.best_angle(typed_segments(t), ["line_id"]).select("line_id", (F.round("score", 3) + 0.0).alias("score"))


@query(
    "a14_ring_area", "v_poly",
    """n AS (SELECT line_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM v_poly WINDOW w AS (PARTITION BY line_id ORDER BY seq))
    SELECT line_id, round(abs(sum(x * ny - nx * y)) / 2, 5) + 0.0 AS area, round(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)), 6) AS perimeter FROM n GROUP BY line_id""",
)
def _(t):
    return ms.ring_area(t.poly, "line_id").select("line_id", (F.round("area", 5) + 0.0).alias("area"), r6("perimeter").alias("perimeter"))


@query(
    "a14_largest_ring", "v_poly",
    """n AS (SELECT line_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM v_poly WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
    a AS (SELECT line_id, string_split(line_id, '-')[1] AS user, round(abs(sum(x * ny - nx * y)) / 2, 5) + 0.0 AS area FROM n GROUP BY line_id)
    SELECT user, line_id, area FROM (SELECT *, row_number() OVER (PARTITION BY user ORDER BY area DESC, line_id) AS k FROM a) WHERE k = 1""",
)
def _(t):
    rings = ms.ring_area(t.poly, "line_id").select("line_id", F.split_part("line_id", F.lit("-"), F.lit(1)).alias("user"), (F.round("area", 5) + 0.0).alias("area"))
    return ms.top1(rings, ["user"], "area", "line_id").select("user", "line_id", "area")


@query(
    "a18_series_f1", "v_poly",
    """g AS (SELECT line_id, x, y, lag(x) OVER w AS px, lead(x) OVER w AS nx FROM v_poly WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
    p AS (SELECT line_id, x + 0.5::DOUBLE AS x, y * 1.1::DOUBLE AS y, px + 0.5::DOUBLE AS px, nx + 0.5::DOUBLE AS nx FROM g),
    e AS (SELECT line_id, (max(y) - min(y)) / 100 AS eps FROM g GROUP BY line_id),
    gs AS (SELECT a.line_id, a.x, a.y, CASE WHEN a.px IS NULL AND a.nx IS NULL THEN 1 ELSE (coalesce(a.nx, a.x) - coalesce(a.px, a.x)) / 2 END AS w, arg_max({'x': b.x, 'y': b.y}, b.x) FILTER (b.x <= a.x) AS l, arg_min({'x': b.x, 'y': b.y}, b.x) FILTER (b.x > a.x) AS r
      FROM g a JOIN p b ON a.line_id = b.line_id GROUP BY ALL),
    ps AS (SELECT a.line_id, a.x, a.y, CASE WHEN a.px IS NULL AND a.nx IS NULL THEN 1 ELSE (coalesce(a.nx, a.x) - coalesce(a.px, a.x)) / 2 END AS w, arg_max({'x': b.x, 'y': b.y}, b.x) FILTER (b.x <= a.x) AS l, arg_min({'x': b.x, 'y': b.y}, b.x) FILTER (b.x > a.x) AS r
      FROM p a JOIN g b ON a.line_id = b.line_id GROUP BY ALL),
    v AS (SELECT 'r' AS k, gs.*, CASE WHEN l IS NULL THEN r.y WHEN r IS NULL THEN l.y ELSE l.y + (r.y - l.y) * (x - l.x) / (r.x - l.x) END AS yi FROM gs
      UNION ALL SELECT 'p', ps.*, CASE WHEN l IS NULL THEN r.y WHEN r IS NULL THEN l.y ELSE l.y + (r.y - l.y) * (x - l.x) / (r.x - l.x) END FROM ps),
    s AS (SELECT v.line_id, k, sum((1 - CASE WHEN abs(y) + eps > 0 THEN least(1, abs(y - yi) / (abs(y) + eps)) WHEN y = yi THEN 0 ELSE 1 END) * w) / sum(w) AS v FROM v JOIN e ON v.line_id = e.line_id GROUP BY v.line_id, k),
    b AS (SELECT line_id, max(v) FILTER (k = 'r') AS r, max(v) FILTER (k = 'p') AS p FROM s GROUP BY line_id)
    SELECT line_id, round(r, 6) AS recall, round(p, 6) AS precision, round(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END, 6) AS f1 FROM b""",
)
def _(t):
    pred = t.poly.select("line_id", (F.col("x") + 0.5).alias("x"), (F.col("y") * 1.1).alias("y"))
    score = ms.series_f1(pred, t.poly.select("line_id", "x", "y"), ["line_id"])
    return score.select("line_id", *[r6(c).alias(c) for c in ("recall", "precision", "f1")])


CURVE_PAIRS = """c AS (SELECT line_id, s, seq, x, y * (1 - 0.5 * s) AS y FROM v_poly, range(2) r(s)),
    ga AS (SELECT line_id, 1 - s AS k, seq, x + 0.1::DOUBLE AS x, y * 0.9::DOUBLE AS y FROM c), pa AS (SELECT line_id, s AS k, seq, x, y FROM c),
    g AS (SELECT *, lag(x) OVER w AS px, lead(x) OVER w AS nx FROM ga WINDOW w AS (PARTITION BY line_id, k ORDER BY seq)),
    p AS (SELECT *, lag(x) OVER w AS px, lead(x) OVER w AS nx FROM pa WINDOW w AS (PARTITION BY line_id, k ORDER BY seq)),
    e AS (SELECT line_id, k AS j, (max(y) - min(y)) / 100 AS eps FROM g GROUP BY ALL),
    gs AS (SELECT 'r' AS w0, a.line_id, b.k AS i, a.k AS j, a.x, a.y, CASE WHEN a.px IS NULL AND a.nx IS NULL THEN 1 ELSE (coalesce(a.nx, a.x) - coalesce(a.px, a.x)) / 2 END AS w, arg_max({'x': b.x, 'y': b.y}, b.x) FILTER (b.x <= a.x) AS l, arg_min({'x': b.x, 'y': b.y}, b.x) FILTER (b.x > a.x) AS r
      FROM g a JOIN p b ON a.line_id = b.line_id GROUP BY ALL),
    ps AS (SELECT 'p' AS w0, a.line_id, a.k AS i, b.k AS j, a.x, a.y, CASE WHEN a.px IS NULL AND a.nx IS NULL THEN 1 ELSE (coalesce(a.nx, a.x) - coalesce(a.px, a.x)) / 2 END AS w, arg_max({'x': b.x, 'y': b.y}, b.x) FILTER (b.x <= a.x) AS l, arg_min({'x': b.x, 'y': b.y}, b.x) FILTER (b.x > a.x) AS r
      FROM p a JOIN g b ON a.line_id = b.line_id GROUP BY ALL),
    v AS (SELECT *, CASE WHEN l IS NULL THEN r.y WHEN r IS NULL THEN l.y ELSE l.y + (r.y - l.y) * (x - l.x) / (r.x - l.x) END AS yi FROM (SELECT * FROM gs UNION ALL SELECT * FROM ps)),
    s AS (SELECT v.line_id, v.i, v.j, w0, sum((1 - CASE WHEN abs(y) + eps > 0 THEN least(1, abs(y - yi) / (abs(y) + eps)) WHEN y = yi THEN 0 ELSE 1 END) * w) / sum(w) AS v FROM v JOIN e ON v.line_id = e.line_id AND v.j = e.j GROUP BY ALL),
    f AS (SELECT line_id, i, j, max(v) FILTER (w0 = 'r') AS r, max(v) FILTER (w0 = 'p') AS p FROM s GROUP BY ALL),
    h AS (SELECT line_id, i, j, CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END AS f1 FROM f),
"""


def noisy_curves(t):
    """Two curves per line, and a prediction of both under swapped names, moved a little."""
    gt = t.poly.select("line_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("series"), "x", "y").withColumn("y", F.col("y") * (1 - 0.5 * F.col("series")))
    return gt.select("line_id", (1 - F.col("series")).alias("series"), (F.col("x") + 0.1).alias("x"), (F.col("y") * 0.9).alias("y")), gt


@query(
    "a19_series_set_score", "v_poly",
    f"""{CURVE_PAIRS}    t AS (SELECT line_id, sum(f1) FILTER (i <> j) AS across, sum(f1) FILTER (i = j) AS along, max(f1) FILTER (i <> j) >= max(f1) FILTER (i = j) AS first FROM h GROUP BY line_id)
    SELECT line_id, round(CASE WHEN first THEN across ELSE along END / 2, 6) AS score_6a, round(CASE WHEN first THEN across ELSE along END / 2, 6) AS score_6b FROM t""",
)
def _(t):
    pred, gt = noisy_curves(t)
    return ms.series_set_score(pred, gt, ["line_id"]).select("line_id", r6("score_6a").alias("score_6a"), r6("score_6b").alias("score_6b"))


@query(
    "a19_series_set_optimal", "v_poly",
    f"""{CURVE_PAIRS}    t AS (SELECT line_id, greatest(coalesce(sum(f1) FILTER (i <> j), 0), coalesce(sum(f1) FILTER (i = j), 0)) AS total FROM h GROUP BY line_id)
    SELECT line_id, round(total / 2, 6) AS score_6a, round(total / 2, 6) AS score_6b FROM t""",
)
def _(t):
    pred, gt = noisy_curves(t)
    score = ms.series_set_score(pred, gt, ["line_id"], pairing=mt.optimal_pairs)
    return score.select("line_id", r6("score_6a").alias("score_6a"), r6("score_6b").alias("score_6b"))


@query(
    "a21_interval_means", "",
    """s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS step FROM events)
    SELECT event_type, step // 20 AS block, round(avg(value), 6) AS value, count(*) AS n FROM s GROUP BY event_type, step // 20""",
)
def _(t):
    steps = pg.ordered_steps(t.events.select("event_type", "ts", "event_id", "value"), ["event_type"], ["ts", "event_id"])
    return ag.interval_means(steps, ["event_type"], "step", 20, ["value"]).select("event_type", "block", r6("value").alias("value"), "n")


# ---- polylines


CUM = """d AS (SELECT line_id, seq, x, y, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS seg FROM v_poly WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
    c AS (SELECT *, sum(seg) OVER (PARTITION BY line_id ORDER BY seq) AS cum FROM d),
    sg AS (SELECT line_id, seq, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_, cum AS d0, lead(cum) OVER w AS d1, max(cum) OVER (PARTITION BY line_id) AS total FROM c WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
    ss AS (SELECT * FROM sg WHERE d1 > d0)"""


@query("w10_cum_length", "v_poly", f"{CUM} SELECT line_id, seq, round(seg, 6) AS seg, round(cum, 6) AS cum FROM c")
def _(t):
    return pl.cum_length(t.poly).select("line_id", "seq", r6("seg").alias("seg"), r6("cum").alias("cum"))


@query(
    "w11_interpolate_line", "v_poly",
    f"""{CUM}, f AS (SELECT DISTINCT line_id, CAST(k AS INT) AS k, total * k / 10 AS spot FROM ss, range(11) r(k)),
    h AS (SELECT f.line_id, k, spot, arg_max(ss, d0) AS s FROM f JOIN ss ON f.line_id = ss.line_id AND ss.d0 <= spot + 1e-9 GROUP BY ALL)
    SELECT line_id, k, round(s.ax + (s.bx - s.ax) * (spot - s.d0) / (s.d1 - s.d0), 4) + 0.0 AS x, round(s.ay + (s.by_ - s.ay) * (spot - s.d0) / (s.d1 - s.d0), 4) + 0.0 AS y FROM h""",
)
def _(t):
    points = pl.interpolate_line(t.poly, 11)
    return points.select("line_id", "k", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


@query(
    "w11_blend_lines", "v_poly",
    f"""{CUM}, f AS (SELECT DISTINCT line_id, k, total * k / 100 AS spot FROM ss, range(101) r(k)),
    h AS (SELECT f.line_id, k, spot, arg_max(ss, d0) AS s FROM f JOIN ss ON f.line_id = ss.line_id AND ss.d0 <= spot + 1e-9 GROUP BY ALL),
    p AS (SELECT line_id, k, s.ax + (s.bx - s.ax) * (spot - s.d0) / (s.d1 - s.d0) AS x, s.ay + (s.by_ - s.ay) * (spot - s.d0) / (s.d1 - s.d0) AS y FROM h)
    SELECT a.line_id, count(*) AS n, round(avg(a.x), 4) AS x, round(avg(0.7 * a.y + 0.3 * (a.y + 10)), 4) AS y FROM p a GROUP BY a.line_id""",
)
def _(t):
    raised = t.poly.withColumn("y", F.col("y") + 10)
    mixed = pl.blend_lines(t.poly, raised, 0.3)
    return mixed.groupBy("line_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 4).alias("x"), F.round(F.avg("y"), 4).alias("y"))


@query(
    "w11_resample_like", "v_poly",
    f"""{CUM}, o AS (SELECT line_id, seq, (seq ** 2) / (n - 1) ** 2 AS f FROM (SELECT line_id, seq, count(*) OVER (PARTITION BY line_id) AS n FROM v_poly) WHERE n > 1),
    h AS (SELECT o.line_id, o.seq, f * total AS spot, arg_max(ss, d0) AS s FROM o JOIN ss ON o.line_id = ss.line_id AND ss.d0 <= f * total + 1e-9 GROUP BY ALL)
    SELECT line_id, seq, round(s.ax + (s.bx - s.ax) * (spot - s.d0) / (s.d1 - s.d0), 4) + 0.0 AS x, round(s.ay + (s.by_ - s.ay) * (spot - s.d0) / (s.d1 - s.d0), 4) + 0.0 AS y FROM h""",
)
def _(t):
    spaced = t.poly.select("line_id", "seq", F.pow(F.col("seq").cast("double"), F.lit(2.0)).alias("x"), F.lit(0.0).alias("y"))
    out = pl.resample_like(t.poly, spaced)
    return out.where("x IS NOT NULL").select("line_id", "seq", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


@query(
    "w12_locate_along", "v_poly",
    f"""{CUM}, q AS (SELECT line_id, seq AS point, x + 0.2::DOUBLE AS x, y + 5 AS y FROM v_poly),
    s AS (SELECT q.line_id, point, sg.seq AS segment, q.x, q.y, ax, ay, bx, by_, d0, d1, greatest(0, least(1, coalesce(((q.x - ax) * (bx - ax) + (q.y - ay) * (by_ - ay)) / nullif((bx - ax) ** 2 + (by_ - ay) ** 2, 0), 0))) AS t
      FROM q JOIN sg ON q.line_id = sg.line_id WHERE d1 IS NOT NULL),
    r AS (SELECT *, sqrt((x - ax - (bx - ax) * t) ** 2 + (y - ay - (by_ - ay) * t) ** 2) AS d FROM s)
    SELECT line_id, point, round(min(d), 6) + 0.0 AS distance FROM r GROUP BY line_id, point""",
)
def _(t):
    points = t.poly.select("line_id", F.col("seq").alias("point"), (F.col("x") + 0.2).alias("x"), (F.col("y") + 5).alias("y"))
    found = pl.locate_along(points, t.poly, ["point"])
    return found.select("line_id", "point", r6("distance").alias("distance"))


@query(
    "w12_locate_own_points", "v_poly",
    f"{CUM} SELECT line_id, seq AS point, 0.0::DOUBLE AS distance, round(cum, 4) + 0.0 AS along FROM c WHERE line_id IN (SELECT line_id FROM ss)",
)
def _(t):
    points = t.poly.select("line_id", F.col("seq").alias("point"), "x", "y")
    found = pl.locate_along(points, t.poly, ["point"])
    return found.select("line_id", "point", r6("distance").alias("distance"), (F.round("along", 4) + 0.0).alias("along"))


@query(
    "w13_substring_line", "v_poly",
    f"""{CUM}, l AS (SELECT DISTINCT line_id, least(10, total) AS a, least(80, total) AS b FROM sg),
    cuts AS (SELECT line_id, a AS spot, a, b FROM l WHERE b > a UNION ALL SELECT line_id, b, a, b FROM l WHERE b > a),
    e AS (SELECT cuts.line_id, spot, arg_max(ss, d0) AS s FROM cuts JOIN ss ON ss.line_id = cuts.line_id AND ss.d0 <= spot GROUP BY ALL),
    p AS (SELECT line_id, round(spot, 6) AS d, s.ax + (s.bx - s.ax) * (spot - s.d0) / (s.d1 - s.d0) AS x, s.ay + (s.by_ - s.ay) * (spot - s.d0) / (s.d1 - s.d0) AS y FROM e
      UNION ALL SELECT c.line_id, round(cum, 6), x, y FROM c JOIN l ON l.line_id = c.line_id WHERE cum > a AND cum < b)
    SELECT line_id, d, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y FROM p""",
)
def _(t):
    cuts = t.poly.select("line_id").distinct().select("line_id", F.lit(10.0).alias("a"), F.lit(80.0).alias("b"))
    part = pl.substring_line(t.poly, cuts)
    return part.select("line_id", r6("d").alias("d"), (F.round("x", 5) + 0.0).alias("x"), (F.round("y", 5) + 0.0).alias("y"))


@query(
    "w14_extend_line", "v_poly",
    f"""{CUM}, e AS (SELECT line_id, arg_min(ss, seq) AS s, arg_max(ss, seq) AS l FROM ss GROUP BY line_id), n AS (SELECT line_id, CAST(max(seq) + 1 AS INT) AS n FROM v_poly GROUP BY line_id)
    SELECT line_id, seq, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y FROM (SELECT line_id, seq, x, y FROM v_poly
      UNION ALL SELECT line_id, -1, s.ax - (s.bx - s.ax) / (s.d1 - s.d0) * 3, s.ay - (s.by_ - s.ay) / (s.d1 - s.d0) * 3 FROM e
      UNION ALL SELECT e.line_id, n, l.bx + (l.bx - l.ax) / (l.d1 - l.d0) * 3, l.by_ + (l.by_ - l.ay) / (l.d1 - l.d0) * 3 FROM e JOIN n ON n.line_id = e.line_id)""",
)
def _(t):
    out = pl.extend_line(t.poly, 3.0)
    return out.select("line_id", "seq", (F.round("x", 5) + 0.0).alias("x"), (F.round("y", 5) + 0.0).alias("y"))


@query(
    "w20_densify", "v_poly",
    """i AS (SELECT line_id, CAST(trunc(x) AS INT) AS x, CAST(trunc(y) AS INT) AS y FROM v_poly),
    u AS (SELECT line_id, x, max(y) AS y FROM i GROUP BY line_id, x HAVING count(*) = 1), k AS (SELECT line_id FROM u GROUP BY line_id HAVING count(*) >= 2),
    l AS (SELECT line_id, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM u WHERE line_id IN (SELECT line_id FROM k) WINDOW w AS (PARTITION BY line_id ORDER BY x))
    SELECT line_id, CAST(x + s AS INT) AS x, CAST(trunc(coalesce(y + (ny - y) / (nx - x) * s, y)) AS INT) AS y FROM l, unnest(range(coalesce(nx - x, 1))) r(s)
    UNION ALL SELECT line_id, x, y FROM i WHERE line_id NOT IN (SELECT line_id FROM k)""",
)
def _(t):
    return pl.densify(t.poly)


# ---- logs


@query(
    "w23_assets_as_of", "v_asset",
    """r AS (SELECT *, sum(CAST(action = 'remove' AS INT)) OVER (PARTITION BY asset ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM v_asset),
    c AS (SELECT *, max(CASE WHEN action = 'create' THEN 1 ELSE 0 END) OVER (PARTITION BY asset, coalesce(run, 0) ORDER BY seq) AS alive FROM r)
    SELECT asset, seq, action, max(CASE WHEN alive = 1 AND action <> 'remove' THEN seq END) OVER (PARTITION BY asset, coalesce(run, 0) ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS version FROM c""",
)
def _(t):
    return pg.assets_as_of(t.asset_log).select("asset", "seq", "action", "version")


@query(
    "w24_best_so_far", "",
    """s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events),
    g AS (SELECT *, best IS NULL OR value > best AS saved FROM s),
    d AS (SELECT *, step - max(CASE WHEN saved THEN step END) OVER (PARTITION BY user_id ORDER BY step) AS since FROM g)
    SELECT user_id, step, saved, since, coalesce(max(CAST(since >= 10 AS INT)) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS stopped FROM d""",
)
def _(t):
    steps = pg.ordered_steps(t.events.select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"])
    return pg.best_so_far(steps, ["user_id"], "step", "value", 10).select("user_id", "step", "saved", "since", "stopped")


@query(
    "w25_monotone_accept", "v_poly",
    """p AS (SELECT user_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 3.6e9 AS x, value AS y FROM events),
    f(line, seq, lx, ly, kept) AS (SELECT line, seq, x, y, true FROM p WHERE seq = 0
      UNION ALL SELECT p.line, p.seq, CASE WHEN ok THEN p.x ELSE lx END, CASE WHEN ok THEN p.y ELSE ly END, ok
      FROM (SELECT p.*, lx, ly, coalesce((p.y - ly) / nullif(p.x - lx, 0) BETWEEN -1 AND 5, false) AS ok FROM f JOIN p ON p.line = f.line AND p.seq = f.seq + 1) p)
    SELECT line, seq FROM f WHERE kept""",
)
def _(t):
    rows = t.events.select(F.col("user_id").alias("line"), "ts", "event_id",
                           (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 3.6e9).alias("x"), F.col("value").alias("y"))
    steps = with_positions(rows, ["line"], ["ts", "event_id"], "seq")
    return pg.monotone_accept(steps, ["line"], -1.0, 5.0).select("line", "seq")


# ---- rounds on boxes, scores and points


@query(
    "g04_suppress_boxes", "v_boxes",
    """b AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score DESC, box_id) AS r, count(*) OVER (PARTITION BY sample) AS n FROM v_boxes),
    o AS (SELECT a.sample, a.r AS better, b.r AS worse FROM b a JOIN b ON a.sample = b.sample AND a.category = b.category AND a.r < b.r
      AND greatest(0, 10 - abs(a.x0 - b.x0)) * greatest(0, 10 - abs(a.y0 - b.y0)) > 0.5 * (200 - greatest(0, 10 - abs(a.x0 - b.x0)) * greatest(0, 10 - abs(a.y0 - b.y0)))),
    g(sample, r, n, kept) AS (SELECT sample, CAST(0 AS BIGINT), max(n), CAST([] AS BIGINT[]) FROM b GROUP BY sample
      UNION ALL SELECT g.sample, g.r + 1, g.n, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.sample = g.sample AND o.worse = g.r + 1 AND list_contains(g.kept, o.better)) THEN g.kept ELSE list_append(g.kept, g.r + 1) END
      FROM g WHERE g.r < g.n)
    SELECT b.sample, box_id FROM b JOIN g ON g.sample = b.sample AND g.r = g.n AND list_contains(g.kept, b.r)""",
)
def _(t):
    return bx.suppress_boxes(t.boxes, ["sample"], "box_id", 0.5).select("sample", "box_id")


@query(
    "g04_suppress_contained", "v_boxes",
    """b AS (SELECT sample, box_id, x0, x0 + 4 + box_id AS x1, y0, row_number() OVER (PARTITION BY sample ORDER BY box_id DESC) AS r, count(*) OVER (PARTITION BY sample) AS n FROM v_boxes),
    o AS (SELECT a.sample, a.r AS better, b.r AS worse FROM b a JOIN b ON a.sample = b.sample AND a.r < b.r
      AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, 10 - abs(a.y0 - b.y0)) >= 0.9 * (b.x1 - b.x0) * 10),
    g(sample, r, n, kept) AS (SELECT sample, CAST(0 AS BIGINT), max(n), CAST([] AS BIGINT[]) FROM b GROUP BY sample
      UNION ALL SELECT g.sample, g.r + 1, g.n, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.sample = g.sample AND o.worse = g.r + 1 AND list_contains(g.kept, o.better)) THEN g.kept ELSE list_append(g.kept, g.r + 1) END
      FROM g WHERE g.r < g.n)
    SELECT b.sample, box_id FROM b JOIN g ON g.sample = b.sample AND g.r = g.n AND list_contains(g.kept, b.r)""",
)
def _(t):
    lines = t.boxes.select("sample", "box_id", "x0", "y0", (F.col("x0") + 4 + F.col("box_id")).alias("x1"), "y1")
    return bx.suppress_contained(lines, ["sample"], "box_id", 0.9, height=10.0).select("sample", "box_id")


@query(
    "g05_greedy_pairs", "v_sim",
    """o AS (SELECT block, i, j, sim, row_number() OVER (PARTITION BY block ORDER BY sim DESC, i, j) AS r, count(*) OVER (PARTITION BY block) AS n FROM v_sim),
    g(block, r, n, ti, tj, taken) AS (SELECT block, CAST(0 AS BIGINT), max(n), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM o GROUP BY block
      UNION ALL SELECT g.block, g.r + 1, g.n, CASE WHEN list_contains(ti, i) OR list_contains(tj, j) THEN ti ELSE list_append(ti, i) END,
        CASE WHEN list_contains(ti, i) OR list_contains(tj, j) THEN tj ELSE list_append(tj, j) END,
        CASE WHEN list_contains(ti, i) OR list_contains(tj, j) THEN taken ELSE list_append(taken, g.r + 1) END
      FROM g JOIN o ON o.block = g.block AND o.r = g.r + 1 WHERE g.r < g.n)
    SELECT o.block, i, j, round(sim, 6) AS score FROM o JOIN g ON g.block = o.block AND g.r = g.n AND list_contains(g.taken, o.r)""",
)
def _(t):
    pairs = mt.greedy_pairs(t.sim.withColumnRenamed("sim", "score"), ["block"])
    return pairs.select("block", "i", "j", r6("score").alias("score"))


@query(
    "g05_optimal_total", "v_sim",
    """r AS (SELECT block, dense_rank() OVER (PARTITION BY block ORDER BY i) - 1 AS a, dense_rank() OVER (PARTITION BY block ORDER BY j) - 1 AS b, sim FROM v_sim),
    o AS (SELECT block, a, CAST(1 AS BIGINT) << b AS bit, sim FROM r WHERE sim > 0 UNION ALL SELECT DISTINCT block, a, CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM r),
    d(block, a, used, total) AS (SELECT DISTINCT block, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM r
      UNION ALL SELECT d.block, d.a + 1, d.used | o.bit, max(d.total + o.sim) FROM d JOIN o ON o.block = d.block AND o.a = d.a AND d.used & o.bit = 0 GROUP BY d.block, d.a, d.used | o.bit)
    SELECT block, round(max(total), 6) + 0.0 AS total FROM d GROUP BY block""",
)
def _(t):
    pairs = mt.optimal_pairs(t.sim.withColumnRenamed("sim", "score"), ["block"])
    return t.sim.select("block").distinct().join(pairs.groupBy("block").agg(F.sum("score").alias("_s")), "block", "left").select("block", r6(F.coalesce("_s", F.lit(0.0))).alias("total"))


STEEP = "coalesce(CAST(({b}.y - {a}.y) / nullif({b}.x - {a}.x, 0) NOT BETWEEN -60 AND 60 AS INT), 0)"
STEEP_GAIN = " ".join((STEEP.format(a="pts[k - 1]", b="pts[k]"), "+", STEEP.format(a="pts[k]", b="pts[k + 1]"), "-", STEEP.format(a="pts[k - 1]", b="pts[k + 1]")))


@query(
    "g06_eliminate", "v_poly",
    f"""g(line_id, n, pts) AS (SELECT line_id, 0, list({{'seq': seq, 'x': x, 'y': y}} ORDER BY seq) FROM v_poly GROUP BY line_id
      UNION ALL SELECT line_id, n + 1, list_concat(pts[1:gone - 1], pts[gone + 1:len(pts)])
      FROM (SELECT *, list_position(gains, list_max(gains)) AS gone FROM (SELECT *, list_transform(range(1, len(pts) + 1), lambda k: {STEEP_GAIN}) AS gains FROM g)) WHERE list_max(gains) > 0),
    l AS (SELECT line_id, unnest(arg_max(pts, n)) AS p FROM g GROUP BY line_id)
    SELECT line_id, p.seq AS seq, p.x AS x, p.y AS y FROM l""",
)
def _(t):
    return gr.eliminate(t.poly, ["line_id"], -60.0, 60.0).select("line_id", "seq", "x", "y")


@query(
    "g07_label_corners", "v_boxes",
    """p AS (SELECT sample, box_id, (k + 2) % 4 AS seq, CASE WHEN k IN (0, 3) THEN x0 ELSE x1 END + CASE WHEN k = 0 THEN 1 ELSE 0 END AS x, CASE WHEN k IN (0, 1) THEN y0 ELSE y1 END AS y, k FROM v_boxes, range(4) r(k))
    SELECT sample, box_id, CAST(seq AS INT) AS seq, x, y, ['top_left', 'top_right', 'bottom_right', 'bottom_left'][k + 1] AS corner FROM p""",
)
def _(t):
    ring = F.array(*[
        F.struct(F.lit((k + 2) % 4).alias("seq"), (F.col("x0" if k in (0, 3) else "x1") + (1 if k == 0 else 0)).alias("x"), F.col("y0" if k in (0, 1) else "y1").alias("y"))
        for k in range(4)
    ])
    return gr.label_corners(t.boxes.select("sample", "box_id", F.inline(ring)), ["sample", "box_id"])


# ---- order, unions, differences


@query(
    "t02_best_per_group", "v_poly",
    """d AS (SELECT line_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS s FROM v_poly WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
    l AS (SELECT line_id, string_split(line_id, '-')[1] AS user, round(coalesce(sum(s), 0), 6) AS length FROM d GROUP BY line_id)
    SELECT user, line_id, length FROM (SELECT *, row_number() OVER (PARTITION BY user ORDER BY length DESC, line_id) AS n FROM l) WHERE n = 1""",
)
def _(t):
    lengths = pl.line_lengths(t.poly).select(F.split_part("line_id", F.lit("-"), F.lit(1)).alias("user"), "line_id", r6("length").alias("length"))
    return ms.top1(lengths, ["user"], "length", "line_id").select("user", "line_id", "length")


@query(
    "u01_union_lines", "v_textlines v_poly",
    "SELECT type AS kind, line_id AS id, CAST(NULL AS VARCHAR) AS text, count(*) AS points FROM v_poly GROUP BY ALL UNION ALL SELECT 'text', doc_id || '-' || line_no, text, NULL FROM v_textlines",
)
def _(t):
    structural = t.poly.groupBy(F.col("type").alias("kind"), F.col("line_id").alias("id")).agg(F.count(F.lit(1)).alias("points"))
    text = t.textlines.select(F.lit("text").alias("kind"), F.concat_ws("-", "doc_id", "line_no").alias("id"), "text")
    return jn.union_lines(structural, text)


@query(
    "u02_add_borders", "v_manifest",
    """SELECT sample, 'text_line' AS type, key AS id, CAST(NULL AS DOUBLE) AS x0, CAST(NULL AS DOUBLE) AS y1 FROM v_manifest
    UNION ALL SELECT sample, b.* FROM v_manifest, (VALUES ('vertical_line', 'border_left', 0.0::DOUBLE, 1.0::DOUBLE), ('horizontal_line', 'border_top', 0.0::DOUBLE, 0.0::DOUBLE),
      ('vertical_line', 'border_right', 1.0::DOUBLE, 1.0::DOUBLE), ('horizontal_line', 'border_bottom', 0.0::DOUBLE, 1.0::DOUBLE)) b""",
)
def _(t):
    lines = t.manifest.select("sample", F.lit("text_line").alias("type"), F.col("key").alias("id"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("line"))
    rows = jn.add_borders(lines)
    return rows.select("sample", "type", "id", F.element_at("line", 1)["x"].alias("x0"), F.element_at("line", -1)["y"].alias("y1"))


@query("u03_set_difference", "", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def _(t):
    return jn.minus(t.documents.select("doc_id"), t.labels.where("quality = 1").select("doc_id"))


@query(
    "u03_difference_size", "",
    """SELECT (SELECT count(*) FROM (SELECT lang FROM documents EXCEPT ALL SELECT d.lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id)) AS left_only, CAST(0 AS BIGINT) AS right_only""",
)
def _(t):
    labelled = t.documents.join(t.labels, "doc_id", "left_semi").select("lang")
    return jn.difference_size(t.documents.select("lang"), labelled)


# ---- training sets

PRINTABLE = "abcdefghijklmnopqrstuvwxyz"


@query(
    "r01_subsample_pairs", "v_textlines",
    """n AS (SELECT doc_id, count(DISTINCT line_no) AS n FROM v_textlines GROUP BY doc_id),
    p AS (SELECT doc_id, n, greatest(40 - n, 14) AS pairs FROM n WHERE n >= 20)
    SELECT doc_id, pairs AS n_pair, 20 - pairs AS n_a, 20 - pairs AS n_b, 20 + 20 - pairs AS n_items, 0::BIGINT AS too_few FROM p
    UNION ALL SELECT doc_id, 0, 0, 0, 0, n FROM n WHERE n < 20""",
)
def _(t):
    drawn, rejected = sp.subsample_pairs(t.textlines, ["doc_id"], "line_no", 20, 0.666, 7)
    count = lambda role: F.count_if(F.col("role") == role).alias(f"n_{role}")
    told = drawn.groupBy("doc_id").agg(count("pair"), count("a"), count("b"), F.countDistinct("line_no").alias("n_items")).withColumn("too_few", F.lit(0).cast("long"))
    return told.unionByName(rejected.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_pair", "n_a", "n_b", "n_items")], F.col("available").alias("too_few")))


@query("r02_shuffle", "v_textlines")
def _(t):
    return sp.shuffle(t.textlines.select("doc_id", "line_no"), ["doc_id"], ["line_no"], 7)


@query("r02_shuffle_ranks", "v_textlines", "SELECT doc_id, count(*) AS ranks, 0::BIGINT AS low, count(*) - 1 AS high, CAST(sum(line_no) AS BIGINT) AS lines FROM v_textlines GROUP BY doc_id")
def _(t):
    rows = sp.shuffle(t.textlines.select("doc_id", "line_no"), ["doc_id"], ["line_no"], 7)
    ranks = [F.countDistinct("rank").alias("ranks"), F.min("rank").alias("low"), F.max("rank").alias("high")]
    return rows.groupBy("doc_id").agg(*ranks, F.sum("line_no").alias("lines"))


@query("r03_mutate_rates", "v_textlines", "SELECT doc_id, line_no, md5(text) AS same, 0 AS n_gone FROM v_textlines")
def _(t):
    """Rate 0 changes nothing; at rate 1 every character is deleted."""
    none, all_ = (sp.mutate_text("text", ["doc_id", "line_no"], rate, PRINTABLE, 7) for rate in (-1.0, 1.0))
    return t.textlines.select("doc_id", "line_no", F.md5(none).alias("same"), F.length(all_).alias("n_gone"))


@query("r03_mutate_text", "v_textlines")
def _(t):
    noisy = sp.mutate_text("text", ["doc_id", "line_no"], 0.05, PRINTABLE, 7)
    return t.textlines.select("doc_id", "line_no", noisy.alias("text"))


@query(
    "r04_crop_pair", "",
    """p AS (SELECT vec_id, text, CAST(embedding AS DOUBLE[]) AS v, vec_id % 5 / 20 AS s, 1 - vec_id % 3 / 10 AS e FROM embeddings JOIN documents ON doc_id = vec_id),
    q AS (SELECT vec_id, substr(text, CAST(trunc(s * length(text)) AS INT) + 1, CAST(trunc(e * length(text)) - trunc(s * length(text)) AS INT)) AS text, v, trunc(s * 64) AS a, trunc(e * 64) - trunc(s * 64) AS n FROM p),
    r AS (SELECT vec_id, md5(text) AS digest, CAST(t AS INT) AS pos, v, a, n, greatest(0, least((t + 0.5) * n / 64 - 0.5, n - 1)) AS spot FROM q, range(64) r(t))
    SELECT vec_id, digest, pos, round(v[CAST(a + floor(spot) AS INT) + 1] + (v[CAST(a + least(floor(spot) + 1, n - 1) AS INT) + 1] - v[CAST(a + floor(spot) AS INT) + 1]) * (spot - floor(spot)), 6) + 0.0 AS value FROM r""",
)
def _(t):
    start, end = F.col("vec_id") % 5 / 20, 1 - F.col("vec_id") % 3 / 10
    rows = t.embeddings.join(t.documents.withColumnRenamed("doc_id", "vec_id"), "vec_id")
    cropped = rows.select("vec_id", F.md5(sp.crop_text("text", start, end)).alias("digest"), sp.crop_sequence(F.col("embedding").cast("array<double>"), start, end).alias("v"))
    return cropped.select("vec_id", "digest", F.posexplode("v").alias("pos", "value")).withColumn("value", r6("value"))


@query("r05_maybe_reverse", "")
def _(t):
    turned = sp.maybe_reverse(F.col("embedding").cast("array<double>"), ["vec_id"], 7)
    return t.embeddings.select("vec_id", F.element_at(turned, 1).alias("first"), F.element_at(turned, -1).alias("last"))


@query(
    "r05_reversed_ends", "",
    "SELECT vec_id, least(CAST(embedding[1] AS DOUBLE), CAST(embedding[64] AS DOUBLE)) AS low, greatest(CAST(embedding[1] AS DOUBLE), CAST(embedding[64] AS DOUBLE)) AS high, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings",
)
def _(t):
    """Turned or not, the ends are the same two values."""
    turned = sp.maybe_reverse(F.col("embedding").cast("array<double>"), ["vec_id"], 7)
    ends = [F.element_at(turned, k) for k in (1, -1)]
    return t.embeddings.select("vec_id", F.least(*ends).alias("low"), F.greatest(*ends).alias("high"), r6(F.aggregate(turned, F.lit(0.0), lambda a, b: a + b)).alias("total"))


@query(
    "r06_distractor_counts", "v_poly",
    """l AS (SELECT split_part(line_id, '-', 2) AS day, type, line_id FROM v_poly GROUP BY ALL HAVING count(*) >= 2), m AS (SELECT day, type, count(*) AS m FROM l GROUP BY ALL)
    SELECT day, type, CAST(floor(m * 0.5) AS BIGINT) AS lines, CAST(101 * floor(m * 0.5) AS BIGINT) AS points FROM m WHERE m >= 2""",
)
def _(t):
    day = F.split_part("line_id", F.lit("-"), F.lit(2)).alias("day")
    lines = t.poly.groupBy(day, "type", "line_id").agg(F.lit(2.0).alias("width"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    rows = sp.add_distractors(t.poly, lines, ["day", "type"], 0.5, 7)
    return rows.groupBy("day", "type").agg(F.countDistinct("line_id").alias("lines"), F.count(F.lit(1)).alias("points"))


@query("r06_add_distractors", "v_poly")
def _(t):
    day = F.split_part("line_id", F.lit("-"), F.lit(2)).alias("day")
    lines = t.poly.groupBy(day, "type", "line_id").agg(F.when(F.count(F.lit(1)) % 2 == 0, F.max("y")).alias("width"))
    return sp.add_distractors(t.poly, lines, ["day", "type"], 0.5, 7)


@query(
    "r07_tiles", "v_boxes",
    """tiles AS (SELECT layer, CAST(i AS INT) AS tile, CASE layer WHEN 0 THEN 0 WHEN 1 THEN (i // 2) * 25 ELSE (i // 4) * 14 END AS tx0, CASE layer WHEN 0 THEN 0 WHEN 1 THEN (i % 2) * 5 ELSE (i % 4) * 4 END AS ty0,
        CASE layer WHEN 0 THEN 60 WHEN 1 THEN 35 ELSE 19 END AS w, CASE layer WHEN 0 THEN 20 WHEN 1 THEN 15 ELSE 9 END AS h
      FROM (VALUES (0, 1), (1, 4), (2, 16)) l(layer, n), unnest(range(n)) u(i))
    SELECT sample, box_id, layer, tile FROM v_boxes JOIN tiles ON tx0 < x1 AND least(tx0 + w, 60) > x0 AND ty0 < y1 AND least(ty0 + h, 20) > y0""",
)
def _(t):
    return sp.assign_tiles(t.boxes, 20, 60, 2, 0.5).select("sample", "box_id", "layer", "tile")


@query(
    "r07_point_grid", "v_manifest",
    "SELECT sample, (2 * x + 1) / 8 AS x, (2 * y + 1) / 8 AS y FROM v_manifest, range(4) a(x), range(4) b(y)",
)
def _(t):
    return t.manifest.select("sample", F.inline(sp.point_grid(4)))


@query(
    "r08_annotations", "v_poly",
    """l AS (SELECT line_id, CAST(contains(any_value(type), 'text') AS INT) AS category, count(*) % 3 AS c, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM v_poly GROUP BY line_id),
    w AS (SELECT *, CASE c WHEN 0 THEN 6 WHEN 1 THEN 6 ELSE 4 END / 2 AS h FROM l)
    SELECT line_id, category, round(x0 - h, 6) AS x0, round(y0 - h, 6) AS y0, round(x1 - x0 + 2 * h, 6) AS w, round((x1 - x0 + 2 * h) * (y1 - y0 + 2 * h), 5) AS area, 8 AS ring_size FROM w""",
)
def _(t):
    size = F.count(F.lit(1)) % 3
    lines = t.poly.groupBy("line_id").agg(F.first("type").alias("type"), F.when(size == 0, 0.0).when(size == 2, 4.0).alias("width"))
    rows = sp.annotations(t.poly, lines, 6.0)
    return rows.select("line_id", "category", r6("x0").alias("x0"), r6("y0").alias("y0"), r6("w").alias("w"), F.round("area", 5).alias("area"), F.size("ring").alias("ring_size"))


# ---- user code


def _load_weights():
    return [(k + 1) / 64 for k in range(64)]


def _predict(weights, batch: pd.DataFrame) -> pd.DataFrame:
    import numpy as np

    vectors = np.stack(batch["embedding"].to_numpy()).astype("float64")
    return pd.DataFrame({"vec_id": batch["vec_id"], "score": vectors @ np.array(weights)})


@query(
    "m01_score_batches", "v_series",
    "SELECT vec_id, round(sum(value * (pos + 1) / 64), 6) + 0.0 AS score FROM v_series GROUP BY vec_id",
)
def _(t):
    scores = so.score_batches(t.embeddings.select("vec_id", "embedding"), _load_weights, _predict, "vec_id bigint, score double")
    return scores.select("vec_id", r6("score").alias("score"))


def _scale_value(row: dict, factor: float) -> dict:
    if row["event_type"] == "error":
        raise ValueError("no value for error events")
    return {"scaled": row["value"] * factor}


@query(
    "m02_map_rows", "",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN round(value * 2.5::DOUBLE, 6) END AS scaled,
      CASE WHEN event_type = 'error' THEN 'ValueError: no value for error events' END AS error FROM events""",
)
def _(t):
    rows = so.map_rows(t.events.select("event_id", "event_type", "value"), _scale_value, "event_id", "scaled double", factor=2.5)
    return rows.select("event_id", r6("scaled").alias("scaled"), "error")


# ---- streams


@query("i01_incremental_ingest", "", "SELECT event_id, user_id, event_type FROM events")
def _(t):
    rows = t.events.select("event_id", "user_id", "event_type")
    checkpoint, sink, inbox = (new_folder(t.spark, name) for name in ("ingest-state", "ingested", "inbox"))
    # two thirds arrive first; then the rest, with a third seen before
    rows.where("event_id % 3 <> 2").write.parquet(inbox)
    source = st.file_stream(t.spark, inbox, rows.schema)
    st.ingest_stream(source, "event_id", checkpoint, sink)
    rows.where("event_id % 3 <> 1").write.mode("append").parquet(inbox)
    st.ingest_stream(source, "event_id", checkpoint, sink)
    return t.spark.read.schema(source.schema).parquet(sink).select(*source.columns)


@query("i01_ledger_batches", "", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 2 WHEN event_id % 5 = 3 THEN 1 ELSE 0 END::BIGINT AS ingest_batch FROM events")
def _(t):
    """Three deliveries with overlaps; every sample stays in the batch that brought it first."""
    rows = t.events.select("event_id", "user_id")
    checkpoint, sink, inbox = (new_folder(t.spark, name) for name in ("ledger-state", "ledger-sink", "ledger-inbox"))
    for last in (2, 3, 4):
        rows.where(F.pmod("event_id", F.lit(5)).between(last - 2, last)).write.mode("append").parquet(inbox)
        st.ingest_stream(st.file_stream(t.spark, inbox, rows.schema), "event_id", checkpoint, sink, 64)
    return t.spark.read.schema("event_id long, ingest_batch long").parquet(sink)


@query("i02_running_class_iou", "v_class", f"{IOU_BASE} {IOU_COLUMNS} FROM s")
def _(t):
    documents = st.table_stream(t.spark, f"{t.folder}/documents.parquet")
    rows = documents.join(t.labels, "doc_id").select((F.col("n_chars") > 1000).cast("int").alias("pred"), F.col("quality").alias("gt"))
    sink = new_folder(t.spark, "class-counts")
    st.class_counts_stream(rows, 2, new_folder(t.spark, "class-state"), sink)
    return ag.class_scores(st.latest_counts(t.spark, sink, 2)).select("class", *[r6(c).alias(c) for c in ("iou", "fp_ratio", "fn_ratio")])
