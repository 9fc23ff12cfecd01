"""Projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import scalars as fn
from pagemill.operators import boxes as bx
from pagemill.operators import polylines as pl
from pagemill.operators import scaling as sc
from pagemill.plans.registry import query, r6

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 .,:;-"


@query(
    "p01_prefixes", "",
    "SELECT c_custkey, regexp_replace(c_name || '-' || c_mktsegment, '^[^-]*-', '') AS stripped, replace(c_name, 'Customer#', 'warpedgt-') AS swapped FROM customer",
)
def _(t):
    return t.customer.select(
        "c_custkey",
        fn.strip_prefix(F.concat_ws("-", "c_name", "c_mktsegment")).alias("stripped"),
        fn.swap_prefix("c_name", "Customer#", "warpedgt-").alias("swapped"),
    )


@query(
    "p02_fit_area", "",
    """SELECT p_partkey, w, CAST(floor(598400.0::DOUBLE / w) AS INT) AS h FROM (SELECT p_partkey,
      CAST(floor(sqrt(598400.0::DOUBLE / (CAST(p_size AS DOUBLE) / p_retailprice))) AS INT) AS w FROM part)""",
)
def _(t):
    size = fn.fit_area("p_size", "p_retailprice", 598400)
    return t.part.select("p_partkey", size.alias("s")).select("p_partkey", "s.w", "s.h")


@query(
    "p03_box_conversions", "v_boxes",
    """SELECT sample, box_id, x1 - x0 AS w, y1 - y0 AS h, x0 AS bx0, y1 AS by1, x0 / 60 AS nx, y0 / 20 AS ny FROM v_boxes""",
)
def _(t):
    boxes = t.boxes.withColumn("xywh", fn.box_xywh("x0", "y0", "x1", "y1"))
    boxes = boxes.withColumn("ring", fn.box_corners("xywh.x", "xywh.y", "xywh.w", "xywh.h"))
    unit = F.element_at(fn.page_normalize("ring", F.lit(60.0), F.lit(20.0)), 1)
    box = fn.points_bbox("ring")
    out = boxes.select("sample", "box_id", "xywh.w", "xywh.h", box["x0"].alias("bx0"), box["y1"].alias("by1"), unit["x"].alias("nx"), unit["y"].alias("ny"))
    return out.select("sample", "box_id", "w", "h", "bx0", "by1", r6("nx").alias("nx"), r6("ny").alias("ny"))


@query(
    "p04_scale_line", "v_poly",
    """SELECT line_id, count(*) AS n, round(sum(x * 0.5::DOUBLE), 6) + 0.0 AS sx, round(sum(y * 0.5::DOUBLE), 6) + 0.0 AS sy,
      CAST(trunc(count(*) * 0.7::DOUBLE) AS INT) AS width FROM v_poly GROUP BY line_id""",
)
def _(t):
    n = F.count(F.lit(1))
    return pl.scale_points(t.poly, 0.5).groupBy("line_id").agg(
        n.alias("n"), r6(F.sum("x")).alias("sx"), r6(F.sum("y")).alias("sy"), fn.scale_width(n, F.lit(0.7)).alias("width")
    )


@query(
    "p04_scale_line_docs", "v_lines",
    """SELECT doc_id, line_no, x0 * 0.25::DOUBLE AS x0, x1 * 0.25::DOUBLE AS x1, y * 0.5::DOUBLE AS y, CAST(trunc(10 * 0.25::DOUBLE) AS INT) AS width,
      x1 > x0 AS horizontal, y <= 400 * 0.05::DOUBLE OR y >= 400 * 0.95::DOUBLE OR x1 <= 600 * 0.05::DOUBLE OR x0 >= 600 * 0.95::DOUBLE AS border
    FROM v_lines WHERE x0 IS NOT NULL""",
)
def _(t):
    lines = t.line_rows.where("line IS NOT NULL")
    scaled = lines.withColumn("scaled", fn.clip_line(fn.canonical_line(fn.scale_line("line", F.lit(0.25), F.lit(0.5))), 1e9, 1e9))
    ends = [F.element_at("scaled", k) for k in (1, -1)]
    return scaled.where(~fn.has_gap("scaled")).select(
        "doc_id", "line_no", ends[0]["x"].alias("x0"), ends[1]["x"].alias("x1"), ends[0]["y"].alias("y"),
        fn.scale_width("width", F.lit(0.25)).alias("width"), fn.is_horizontal("line").alias("horizontal"),
        fn.is_border("line", 0.05, 600.0, 400.0).alias("border"),
    )


@query(
    "p05_rescale_points", "v_poly",
    "SELECT line_id, seq, CAST(trunc((x - 30) / 1.5::DOUBLE) AS INT) + 12 AS x, CAST(trunc((y - 4) / 0.5::DOUBLE) AS INT) + 3 AS y FROM v_poly",
)
def _(t):
    return t.poly.select(
        "line_id", "seq",
        fn.rescale("x", F.lit(30), F.lit(1.5), F.lit(12)).alias("x"),
        fn.rescale("y", F.lit(4), F.lit(0.5), F.lit(3)).alias("y"),
    )


@query(
    "p06_uncrop", "v_boxes",
    """SELECT sample, box_id, x0 + CASE category WHEN 'A' THEN 0 WHEN 'N' THEN 100 ELSE 200 END AS x0, y0 + 50 AS y0,
      x1 + CASE category WHEN 'A' THEN 0 WHEN 'N' THEN 100 ELSE 200 END AS x1, y1 + 50 AS y1 FROM v_boxes""",
)
def _(t):
    tiles = t.boxes.select(F.col("category").alias("tile")).distinct().select(
        "tile", offset_for("tile").alias("dx"), F.lit(50.0).alias("dy")
    )
    return bx.uncrop(t.boxes.withColumn("tile", F.col("category")), tiles, "tile").select("sample", "box_id", "x0", "y0", "x1", "y1")


def offset_for(tile):
    return F.when(F.col(tile) == "A", 0.0).when(F.col(tile) == "N", 100.0).otherwise(200.0)


@query(
    "p07_near_crop_edge", "v_boxes",
    """SELECT sample, box_id, (abs(x0 - 5) <= 20 AND NOT abs(x0) <= 20) OR (abs(y0 - 2) <= 20 AND NOT abs(y0) <= 20)
      OR (abs(x1 - 55) <= 20 AND NOT abs(x1 - 80) <= 20) OR (abs(y1 - 40) <= 20 AND NOT abs(y1 - 60) <= 20) AS near FROM v_boxes""",
)
def _(t):
    lits = lambda *v: [F.lit(float(x)) for x in v]
    near = fn.near_crop_edge(["x0", "y0", "x1", "y1"], lits(5, 2, 55, 40), lits(0, 0, 80, 60))
    return t.boxes.select("sample", "box_id", near.alias("near"))


@query(
    "p08_filter_scores", "v_boxes",
    "SELECT sample, box_id, score FROM v_boxes WHERE score > 0.02 AND x0 / 50 > 0.5 AND 1 - y0 / 100 >= 0.95",
)
def _(t):
    rows = t.boxes.withColumn("iou", F.col("x0") / 50).withColumn("stability", 1 - F.col("y0") / 100)
    return bx.filter_scores(rows, score=0.02, iou=0.5, stability=0.95).select("sample", "box_id", "score")


@query(
    "p09_line_predicates", "v_poly",
    """SELECT line_id, max(x) - min(x) > max(y) - min(y) AS horizontal,
      (max(x) <= 720 * 0.05::DOUBLE) OR (min(x) >= 720 * (1 - 0.05::DOUBLE)) OR (max(y) <= 500 * 0.05::DOUBLE) OR (min(y) >= 500 * (1 - 0.05::DOUBLE)) AS border,
      (max(x) <= 720 * 0.025::DOUBLE) OR (min(x) >= 720 * (1 - 0.025::DOUBLE)) OR (max(y) <= 500 * 0.025::DOUBLE) OR (min(y) >= 500 * (1 - 0.025::DOUBLE)) AS border_v2
    FROM v_poly GROUP BY line_id""",
)
def _(t):
    return pl.line_flags(t.poly, {"border": 0.05, "border_v2": 0.025}, 720.0, 500.0)


@query(
    "p10_filter_by_length", "v_poly",
    """d AS (SELECT line_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS s FROM v_poly WINDOW w AS (PARTITION BY line_id ORDER BY seq))
    SELECT line_id, round(sum(s), 6) AS length FROM d GROUP BY line_id HAVING sum(s) > 60""",
)
def _(t):
    return pl.filter_by_length(t.poly, 60.0).select("line_id", r6("length").alias("length"))


@query(
    "p11_canonical_line", "v_poly",
    """f AS (SELECT line_id, arg_min(y, seq) > arg_max(y, seq) AS flip, count(*) AS n FROM v_poly GROUP BY line_id)
    SELECT p.line_id, CAST(CASE WHEN flip THEN n - 1 - seq ELSE seq END AS INT) AS seq, round(y, 4) + 0.0 AS x, round(x, 4) + 0.0 AS y
    FROM v_poly p JOIN f ON p.line_id = f.line_id""",
)
def _(t):
    lines = t.poly.select("line_id", "seq", F.col("y").alias("x"), F.col("x").alias("y"))
    return pl.canonical_points(lines).select("line_id", "seq", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))


@query(
    "p12_clean_line", "v_poly",
    """SELECT line_id, seq, greatest(0, least(x / 700, 1))::DOUBLE AS x, greatest(0, least(y / 100, 1))::DOUBLE AS y FROM v_poly
    WHERE line_id NOT IN (SELECT line_id FROM v_poly WHERE y > 200)""",
)
def _(t):
    mapped = t.poly.select("line_id", "seq", (F.col("x") / 700).alias("x"), F.when(F.col("y") <= 200, F.col("y") / 100).otherwise(F.lit(float("nan"))).alias("y"))
    return pl.clean_lines(mapped, "line_id").select("line_id", "seq", "x", "y")


@query(
    "p13_pos_encode", "v_poly",
    "SELECT line_id, seq, " + ", ".join(
        f"round({f}({v} / {10000.0 ** (4.0 * i / 8)!r}::DOUBLE), 6) + 0.0 AS e{k}"
        for k, (v, i, f) in enumerate([(v, i, f) for v in "xy" for i in range(2) for f in ("sin", "cos")])
    ) + " FROM v_poly",
)
def _(t):
    coded = t.poly.select("line_id", "seq", fn.pos_encode("x", "y", 8).alias("e"))
    return coded.select("line_id", "seq", *[r6(F.col("e")[k]).alias(f"e{k}") for k in range(8)])


@query(
    "p14_char_index", "v_textlines",
    f"""c AS (SELECT doc_id, i AS pos, strpos('{ALPHABET}', chars[i + 1]) - 1 AS idx
      FROM (SELECT doc_id, string_split(text, '') AS chars FROM v_textlines WHERE length(text) > 0) s, unnest(range(len(chars))) u(i))
    SELECT doc_id, count(*) AS n, CAST(sum(idx) AS BIGINT) AS index_sum, CAST(sum(pos * idx) AS BIGINT) AS weighted_sum FROM c WHERE idx >= 0 GROUP BY doc_id""",
)
def _(t):
    chars = t.textlines.select("doc_id", F.explode(fn.char_index("text", ALPHABET)).alias("e"))
    pos, index = F.col("e.pos").cast("long"), F.col("e.index").cast("long")
    return chars.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(index).alias("index_sum"), F.sum(pos * index).alias("weighted_sum"))


H = (0.9, 0.1, 0.02, -0.1, 0.95, 0.03, 0.05, 0.02)


@query(
    "p15_project_points", "v_poly",
    """u AS (SELECT line_id, seq, x / 720 AS x, y / 500 AS y FROM v_poly),
    d AS (SELECT *, 0.05::DOUBLE * x + 0.02::DOUBLE * y + 1 AS d FROM u)
    SELECT line_id, seq, round(greatest(0, least(1, (0.9::DOUBLE * x + 0.1::DOUBLE * y + 0.02::DOUBLE) / d)), 6)::DOUBLE AS x,
      round(greatest(0, least(1, (-0.1::DOUBLE * x + 0.95::DOUBLE * y + 0.03::DOUBLE) / d)), 6)::DOUBLE AS y FROM d""",
)
def _(t):
    unit = t.poly.select("line_id", "seq", (F.col("x") / 720).alias("x"), (F.col("y") / 500).alias("y"))
    matrices = unit.select("line_id").distinct().select("line_id", *[F.lit(v).alias(f"h{k}") for k, v in enumerate(H)], F.lit(1.0).alias("h8"))
    return pl.project_points(unit, matrices, "line_id").select("line_id", "seq", r6("x").alias("x"), r6("y").alias("y"))


@query(
    "p15_page_fit", "v_poly",
    """u AS (SELECT line_id, x / 720 AS x, y / 500 AS y FROM v_poly)
    SELECT line_id, round(1 / (max(x) - min(x)), 6) AS xfact, round(1 / (max(y) - min(y)), 6) AS yfact FROM u GROUP BY line_id HAVING count(*) > 1 AND max(x) > min(x) AND max(y) > min(y)""",
)
def _(t):
    unit = t.poly.select("line_id", (F.col("x") / 720).alias("x"), (F.col("y") / 500).alias("y"))
    fit = pl.page_fit(unit, "line_id").where("xfact IS NOT NULL AND yfact IS NOT NULL")
    return fit.select("line_id", r6("xfact").alias("xfact"), r6("yfact").alias("yfact"))


@query(
    "p16_standardize", "v_series",
    """s AS (SELECT pos, avg(value) AS m, stddev_pop(value) AS d FROM v_series GROUP BY pos)
    SELECT vec_id, v.pos, round((value - m) / d, 6) + 0.0 AS value FROM v_series v JOIN s ON v.pos = s.pos""",
)
def _(t):
    from pagemill.operators.aggregates import channel_stats

    stats = channel_stats(t.series, "pos", "value")
    return sc.standardize(t.series, stats, "pos", "value").select("vec_id", "pos", r6("value").alias("value"))


@query(
    "p17_minmax", "v_holed",
    """m AS (SELECT sample, min(value) AS lo, max(value) AS hi FROM v_holed GROUP BY sample)
    SELECT v.sample, y, x, round((value - lo) / (hi - lo), 6) + 0.0 AS value FROM v_holed v JOIN m ON v.sample = m.sample""",
)
def _(t):
    return sc.minmax(t.holed_grid, ["sample"], "value").select("sample", "y", "x", r6("value").alias("value"))


@query(
    "p18_normalize_keypoints", "v_poly",
    """s AS (SELECT line_id, 1 + max(x) - min(x) AS w, 1 + max(y) - min(y) AS h FROM v_poly GROUP BY line_id)
    SELECT p.line_id, seq, round((x - w / 2) / (greatest(w, h) / 2), 6) + 0.0 AS x, round((y - h / 2) / (greatest(w, h) / 2), 6) + 0.0 AS y
    FROM v_poly p JOIN s ON p.line_id = s.line_id""",
)
def _(t):
    return sc.normalize_keypoints(t.poly, ["line_id"]).select("line_id", "seq", r6("x").alias("x"), r6("y").alias("y"))


@query(
    "p19_label_indicators", "v_class",
    "SELECT doc_id, CAST(gt IN (0, 255) AS INT) AS class_0, CAST(gt = 1 AS INT) AS class_1 FROM v_class",
)
def _(t):
    return t.classes.select("doc_id", *fn.label_indicators("gt", 2))


@query(
    "p20_box_all", "v_boxes v_grid",
    """b AS (SELECT sample, box_id, x0 / 10 AS x0, y0 / 4 AS y0, x0 / 10 + 1.5 AS x1, y0 / 4 + 1.5 AS y1 FROM v_boxes)
    SELECT b.sample, b.box_id, count(*) AS cells, bool_and(value <= 0.12) AS blank FROM b JOIN v_grid g ON g.sample = b.sample
      AND g.x >= b.x0 AND g.x < b.x1 AND g.y >= b.y0 AND g.y < b.y1 GROUP BY ALL""",
)
def _(t):
    small = t.boxes.select("sample", "box_id", (F.col("x0") / 10).alias("x0"), (F.col("y0") / 4).alias("y0"),
                           (F.col("x0") / 10 + 1.5).alias("x1"), (F.col("y0") / 4 + 1.5).alias("y1"))
    return bx.box_all(small, t.grid, F.col("value") <= 0.12).select("sample", "box_id", "cells", F.col("all").alias("blank"))
