"""Grids, masks and run lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import aggregates as ag
from pagemill.operators import graphs as gr
from pagemill.operators import grids as gd
from pagemill.plans.registry import query, r6

TAPS = """t AS (SELECT sample, pid, v * 7 AS py, u * 7 AS px FROM places),
    k AS (SELECT sample, pid, floor(py) + dy AS y, floor(px) + dx AS x,
        (CASE WHEN dy = 1 THEN py - floor(py) ELSE 1 - py + floor(py) END) * (CASE WHEN dx = 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) AS w
      FROM t, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(dy, dx)),
    s AS (SELECT k.sample, pid, round(sum(w * coalesce(value, 0)), 6) + 0.0 AS value FROM k LEFT JOIN v_grid g ON g.sample = k.sample AND g.y = k.y AND g.x = k.x WHERE w > 0 GROUP BY k.sample, pid)"""


@query(
    "j12_grid_sample", "v_grid",
    f"""places AS (SELECT sample, y * 8 + x AS pid, y / 7 * 0.9::DOUBLE + 0.03::DOUBLE AS v, x / 7 * 1.1::DOUBLE - 0.05::DOUBLE AS u FROM v_grid), {TAPS}
    SELECT sample, CAST(pid // 8 AS INT) AS y, CAST(pid % 8 AS INT) AS x, value FROM s""",
)
def _(t):
    places = t.grid.select("sample", "y", "x", (F.col("y") / 7 * 0.9 + 0.03).alias("v"), (F.col("x") / 7 * 1.1 - 0.05).alias("u"))
    places = places.withColumnsRenamed({"y": "ty", "x": "tx"})
    out = gd.grid_sample(t.grid, places, ["ty", "tx"])
    return out.select("sample", F.col("ty").alias("y"), F.col("tx").alias("x"), r6("value").alias("value"))


@query(
    "j13_grid_resize", "v_grid",
    f"""places AS (SELECT sample, ty * 12 + tx AS pid, ty / 4 AS v, tx / 11 AS u FROM (SELECT DISTINCT sample FROM v_grid), range(5) a(ty), range(12) b(tx)), {TAPS}
    SELECT sample, CAST(pid // 12 AS INT) AS y, CAST(pid % 12 AS INT) AS x, value FROM s""",
)
def _(t):
    return gd.grid_resize(t.grid, 5, 12).select("sample", "y", "x", r6("value").alias("value"))


@query(
    "j14_map_points", "v_boxes v_grid",
    f"""pts AS (SELECT sample, box_id AS pid, x0 / 45 AS u, y0 / 8 AS v FROM v_boxes WHERE sample IN (SELECT sample FROM v_grid)),
    places AS (SELECT sample, pid, v, u FROM pts WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1), {TAPS}
    SELECT p.sample, p.pid AS box_id, value FROM pts p LEFT JOIN s ON s.sample = p.sample AND s.pid = p.pid""",
)
def _(t):
    points = t.boxes.select("sample", "box_id", (F.col("x0") / 45).alias("x"), (F.col("y0") / 8).alias("y"))
    points = points.join(t.grid.select("sample").distinct(), "sample", "left_semi")
    return gd.map_points(points, t.grid, ["box_id"]).select("sample", "box_id", r6("value").alias("value"))


@query(
    "a20_run_percentile", "v_grid",
    """r AS (SELECT sample, x, y, y - lag(y) OVER (PARTITION BY sample, x ORDER BY y) AS d FROM v_grid WHERE value > 0),
    c AS (SELECT sample, x, count(*) FILTER (d IS NULL OR d > 2) AS n FROM r GROUP BY ALL)
    SELECT sample, CAST(trunc(quantile_cont(n, 0.85)) AS INT) AS runs FROM c GROUP BY sample""",
)
def _(t):
    return gd.run_percentile(gd.column_runs(t.grid.where("value > 0")))


COMPONENTS = """e AS (SELECT sample, y * 8 + x AS id, y, x FROM v_grid WHERE value > 0.15),
    reach(sample, root, id) AS (SELECT sample, id, id FROM e UNION
      SELECT r.sample, r.root, b.id FROM reach r JOIN e a ON a.sample = r.sample AND a.id = r.id JOIN e b ON b.sample = a.sample AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
    lab AS (SELECT sample, id, min(root) AS component FROM reach GROUP BY sample, id)"""


def cell_id():
    return F.expr("sample * 64 + y * 8 + x")


def cell_components(t):
    cells = t.grid.where("value > 0.15")
    edges = gr.cell_edges(cells, ["sample"])
    return gr.components(cells.select(cell_id().alias("id")), edges.select(cell_id().alias("a"), F.expr("sample * 64 + y2 * 8 + x2").alias("b")))


@query(
    "a22_largest_component", "v_grid",
    f"""{COMPONENTS}, n AS (SELECT sample, component, count(*) AS n FROM lab GROUP BY ALL),
    b AS (SELECT sample, component FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY n DESC, component) AS k FROM n) WHERE k = 1)
    SELECT l.sample, CAST(l.id AS INT) AS cell FROM lab l JOIN b ON b.sample = l.sample AND b.component = l.component""",
)
def _(t):
    labels = cell_components(t).withColumn("sample", F.floor(F.col("id") / 64))
    return gr.largest_component(labels, ["sample"]).select("sample", (F.col("id") % 64).cast("int").alias("cell"))


@query("a23_map_error", "v_grid v_holed", "SELECT g.sample, round(avg(abs(g.value - h.value * 0.9::DOUBLE)), 6) AS l1, round(avg((g.value - h.value * 0.9::DOUBLE) ** 2), 6) AS mse FROM v_grid g JOIN v_holed h ON g.sample = h.sample AND g.y = h.y AND g.x = h.x GROUP BY g.sample")
def _(t):
    error = gd.map_error(t.grid, t.holed_grid.withColumn("value", F.col("value") * 0.9))
    return error.select("sample", r6("l1").alias("l1"), r6("mse").alias("mse"))


@query(
    "a24_ms_similarity", "v_grid",
    """b AS (SELECT sample, l, y // CAST(2 ** l AS INT) AS yy, x // CAST(2 ** l AS INT) AS xx, avg(value + 0.5) AS a, avg(value * 0.8::DOUBLE + 0.45::DOUBLE + 0.01::DOUBLE * x) AS b FROM v_grid, range(4) r(l) GROUP BY ALL),
    s AS (SELECT sample, l, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cov FROM b GROUP BY ALL)
    SELECT sample, round(sum([0.0448, 0.2856, 0.3001, 0.2363][l + 1]::DOUBLE * (2 * ma * mb + 1e-4) * (2 * cov + 9e-4) / ((ma * ma + mb * mb + 1e-4) * (va + vb + 9e-4))), 6) AS similarity FROM s GROUP BY sample""",
)
def _(t):
    a = t.grid.withColumn("value", F.col("value") + 0.5)
    b = t.grid.withColumn("value", F.col("value") * 0.8 + 0.45 + F.col("x") * 0.01)
    return gd.ms_similarity(a, b, 4).select("sample", r6("similarity").alias("similarity"))


@query("a25_grid_pool", "v_grid", "SELECT sample, CAST(y // 4 AS INT) AS y, CAST(x // 4 AS INT) AS x, round(avg(value), 6) + 0.0 AS value FROM v_grid GROUP BY sample, y // 4, x // 4")
def _(t):
    return gd.grid_pool(t.grid, 4).select("sample", "y", "x", r6("value").alias("value"))


@query(
    "a26_tight_crop", "v_grid",
    """b AS (SELECT sample, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM v_grid WHERE value > 0.15 GROUP BY sample)
    SELECT g.sample, g.y - y0 AS y, g.x - x0 AS x, value FROM v_grid g JOIN b ON g.sample = b.sample AND g.y >= y0 AND g.y < y1 AND g.x >= x0 AND g.x < x1""",
)
def _(t):
    return gd.tight_crop(t.grid, t.grid.where("value > 0.15"))


@query(
    "a27_mask_boxes", "v_grid",
    """SELECT sample, x // 2 AS mask, coalesce(min(x) FILTER (value > 0.15), 0) AS x0, coalesce(min(y) FILTER (value > 0.15), 0) AS y0,
      coalesce(max(x) FILTER (value > 0.15), 0) AS x1, coalesce(max(y) FILTER (value > 0.15), 0) AS y1 FROM v_grid GROUP BY sample, x // 2""",
)
def _(t):
    masks = t.grid.withColumn("mask", F.floor(F.col("x") / 2).cast("int"))
    return gd.mask_boxes(masks.where("value > 0.15"), masks, ["sample", "mask"])


@query(
    "a28_mask_overlap", "v_grid",
    """a AS (SELECT sample, x // 4 AS a, y, x FROM v_grid WHERE value > 0), b AS (SELECT sample, y // 2 AS b, y, x FROM v_grid WHERE value > -0.05),
    p AS (SELECT a.sample, a, b, count(*) AS n FROM a JOIN b ON a.sample = b.sample AND a.y = b.y AND a.x = b.x GROUP BY ALL)
    SELECT p.sample, p.a, p.b, round(n / (na + nb - n), 6) AS iou, round(n / na, 6) AS inside FROM p
    JOIN (SELECT sample, a, count(*) AS na FROM a GROUP BY ALL) x ON x.sample = p.sample AND x.a = p.a JOIN (SELECT sample, b, count(*) AS nb FROM b GROUP BY ALL) z ON z.sample = p.sample AND z.b = p.b""",
)
def _(t):
    a = t.grid.where("value > 0").select("sample", F.floor(F.col("x") / 4).cast("int").alias("a"), "y", "x")
    b = t.grid.where("value > -0.05").select("sample", F.floor(F.col("y") / 2).cast("int").alias("b"), "y", "x")
    return gd.mask_overlap(a, b, ["sample"], "a", "b").select("sample", "a", "b", r6("iou").alias("iou"), r6("inside").alias("inside"))


@query(
    "w05_slope_violations", "v_grid",
    """d AS (SELECT sample, value - lag(value) OVER (PARTITION BY sample, y ORDER BY x) AS d FROM v_grid UNION ALL
      SELECT sample, value - lag(value) OVER (PARTITION BY sample, x ORDER BY y) FROM v_grid)
    SELECT sample, count(*) FILTER (d < -0.1) AS below, count(*) FILTER (d > 0.2) AS above FROM d GROUP BY sample""",
)
def _(t):
    return gd.slope_violations(t.grid, -0.1, 0.2)


@query(
    "w06_smooth_grid", "v_grid",
    """d AS (SELECT sample, y, x, value - y / 7 AS v FROM v_grid),
    a AS (SELECT sample, y, x, avg(v) OVER (PARTITION BY sample, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM d)
    SELECT sample, y, x, round(avg(v) OVER (PARTITION BY sample, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) + y / 7, 6) + 0.0 AS value FROM a""",
)
def _(t):
    return gd.smooth_grid(t.grid, 3, F.col("y") / 7).select("sample", "y", "x", r6("value").alias("value"))


@query(
    "w07_gauss_smooth", "v_series",
    """SELECT a.vec_id, a.pos, round(sum(exp(-((b.pos - a.pos) ** 2) / 50.0) * b.value) / sum(exp(-((b.pos - a.pos) ** 2) / 50.0)), 6) + 0.0 AS value
    FROM v_series a JOIN v_series b ON a.vec_id = b.vec_id AND abs(a.pos - b.pos) <= 20 GROUP BY ALL""",
)
def _(t):
    return gd.gauss_smooth(t.series, 5.0, ["vec_id"], "pos").select("vec_id", "pos", r6("value").alias("value"))


@query(
    "w08_signal_extent", "v_grid",
    """c AS (SELECT sample, x, count(*) FILTER (value > 0.12) AS n FROM v_grid GROUP BY ALL),
    p AS (SELECT sample, x, n FROM c UNION ALL SELECT DISTINCT sample, e, 0 FROM c, (VALUES (-2), (-1), (8), (9)) v(e)),
    m AS (SELECT sample, x, median(n) OVER (PARTITION BY sample ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM p)
    SELECT sample, min(x) AS first_x, max(x) AS last_x FROM m WHERE x BETWEEN 0 AND 7 AND n <> 0 GROUP BY sample""",
)
def _(t):
    return gd.signal_extent(t.grid.withColumn("value", (F.col("value") > 0.12).cast("int")))


@query(
    "w09_column_runs", "v_grid",
    """r AS (SELECT *, sum(CASE WHEN d <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY sample, x ORDER BY y) AS run FROM
      (SELECT sample, x, y, y - lag(y) OVER (PARTITION BY sample, x ORDER BY y) AS d FROM v_grid WHERE value > 0))
    SELECT sample, x, CAST(run AS BIGINT) AS run, min(y) AS start, max(y) AS "end", CAST(floor((min(y) + max(y)) / 2) AS INT) AS centre FROM r GROUP BY sample, x, run""",
)
def _(t):
    return gd.column_runs(t.grid.where("value > 0")).select("sample", "x", "run", "start", "end", "centre")


@query(
    "w09_single_runs", "v_grid",
    """r AS (SELECT sample, x, y, y - lag(y) OVER (PARTITION BY sample, x ORDER BY y) AS d FROM v_grid WHERE value > 0.05 AND x % 2 = 0)
    SELECT sample, x, CAST(floor((min(y) + max(y)) / 2) AS INT) AS centre FROM r GROUP BY sample, x HAVING count(*) FILTER (d > 2) = 0""",
)
def _(t):
    return gd.column_runs(t.grid.where("value > 0.05"), step=2, single_only=True).select("sample", "x", "centre")


RUNS = """c AS (SELECT sample, x * 8 + y AS spot, CAST(value > 0 AS INT) AS v FROM v_grid),
    k AS (SELECT sample, spot, v, sum(CASE WHEN v = prev THEN 0 ELSE 1 END) OVER (PARTITION BY sample ORDER BY spot) AS run
      FROM (SELECT *, lag(v, 1, 0) OVER (PARTITION BY sample ORDER BY spot) AS prev FROM c)),
    runs AS (SELECT sample, CAST(run AS BIGINT) AS run_no, count(*) AS "count" FROM k GROUP BY ALL UNION ALL SELECT sample, 0, 0 FROM c WHERE spot = 0 AND v = 1)"""


def positive_mask(t):
    return t.grid.withColumn("value", (F.col("value") > 0).cast("int"))


@query("w18_rle_encode", "v_grid", f"""{RUNS} SELECT sample, run_no, "count" FROM runs""")
def _(t):
    return gd.rle_encode(positive_mask(t)).select("sample", "run_no", "count")


@query("w19_rle_decode", "v_grid", "SELECT sample, y, x, CAST(value > 0 AS INT) AS value FROM v_grid")
def _(t):
    packed = gd.rle_pack(gd.rle_encode(positive_mask(t)))
    return gd.rle_decode(gd.rle_unpack(packed), packed.select("sample", F.lit(8).alias("h")))


@query("w19_rle_area", "v_grid", "SELECT sample, count(*) FILTER (value > 0) AS area FROM v_grid GROUP BY sample")
def _(t):
    return gd.rle_pack(gd.rle_encode(positive_mask(t))).select("sample", gd.rle_area("counts").alias("area"))


def fill_sql(line: str, pos: str) -> str:
    return f"""SELECT g.sample, g.y, g.x, CASE WHEN g.value IS NOT NULL THEN g.value WHEN len(l) + len(r) < 2 THEN NULL
        WHEN len(l) > 0 AND len(r) > 0 THEN l[1].v + (r[1].v - l[1].v) * (g.{pos} - l[1].p) / (r[1].p - l[1].p)
        WHEN len(r) = 0 THEN l[1].v + (l[2].v - l[1].v) * (g.{pos} - l[1].p) / (l[2].p - l[1].p)
        ELSE r[1].v + (r[2].v - r[1].v) * (g.{pos} - r[1].p) / (r[2].p - r[1].p) END AS value
      FROM (SELECT a.sample, a.y, a.x, any_value(a.value) AS value,
          coalesce(list({{'p': b.{pos}, 'v': b.value}} ORDER BY b.{pos} DESC) FILTER (b.{pos} < a.{pos}), []) AS l,
          coalesce(list({{'p': b.{pos}, 'v': b.value}} ORDER BY b.{pos}) FILTER (b.{pos} > a.{pos}), []) AS r
        FROM h a LEFT JOIN h b ON a.sample = b.sample AND a.{line} = b.{line} AND b.value IS NOT NULL GROUP BY a.sample, a.y, a.x) g"""


@query(
    "w21_fill_grid", "v_holed",
    f"""h AS (SELECT sample, y, x, value + 0.5 AS value FROM v_holed), fr AS ({fill_sql('y', 'x')}), fc AS ({fill_sql('x', 'y')})
    SELECT fr.sample, fr.y, fr.x, round(greatest(0, least(1, CASE WHEN fr.value IS NULL OR fc.value IS NULL THEN coalesce(fr.value, fc.value) ELSE (fr.value + fc.value) / 2 END)), 6)::DOUBLE AS value
    FROM fr JOIN fc ON fr.sample = fc.sample AND fr.y = fc.y AND fr.x = fc.x""",
)
def _(t):
    return gd.fill_grid(t.holed_grid.withColumn("value", F.col("value") + 0.5)).select("sample", "y", "x", r6("value").alias("value"))


@query(
    "w22_fill_nearest", "v_grid",
    """h AS (SELECT sample, y, x, CASE WHEN (y * 8 + x + sample) % 5 = 0 OR value > 0.1 THEN value END AS value FROM v_grid),
    k AS (SELECT a.sample, a.y, a.x, b.value, row_number() OVER (PARTITION BY a.sample, a.y, a.x ORDER BY (a.y - b.y) ** 2 + (a.x - b.x) ** 2, b.y, b.x) AS n
      FROM h a JOIN h b ON a.sample = b.sample AND b.value IS NOT NULL)
    SELECT sample, y, x, value FROM k WHERE n = 1""",
)
def _(t):
    kept = (F.expr("(y * 8 + x + sample) % 5 = 0")) | (F.col("value") > 0.1)
    return gd.fill_nearest(t.grid.withColumn("value", F.when(kept, F.col("value"))))


@query(
    "g02_cell_edges", "v_grid",
    """c AS (SELECT sample, y, x FROM v_grid WHERE value > 0.15)
    SELECT a.sample, a.y, a.x, b.y AS y2, b.x AS x2 FROM c a JOIN c b ON a.sample = b.sample AND (b.y - a.y, b.x - a.x) IN ((-1, 1), (0, 1), (1, 0), (1, 1))""",
)
def _(t):
    return gr.cell_edges(t.grid.where("value > 0.15"), ["sample"])


@query(
    "g03_longest_path", "v_grid",
    f"""{COMPONENTS}, ed AS (SELECT a.sample, a.id AS a, b.id AS b FROM e a JOIN e b ON a.sample = b.sample AND (b.y - a.y, b.x - a.x) IN ((-1, 1), (0, 1), (1, 0), (1, 1))),
    sz AS (SELECT sample, component, count(*) AS n FROM lab GROUP BY ALL), ne AS (SELECT l.sample, l.component, count(*) AS m FROM ed JOIN lab l ON l.sample = ed.sample AND l.id = ed.a GROUP BY ALL),
    tree AS (SELECT sz.sample, sz.component FROM sz JOIN ne ON ne.sample = sz.sample AND ne.component = sz.component WHERE m < n),
    tl AS (SELECT l.* FROM lab l JOIN tree ON tree.sample = l.sample AND tree.component = l.component),
    both_ways AS (SELECT sample, a, b FROM ed UNION ALL SELECT sample, b, a FROM ed),
    walk(sample, component, start, node, prev, depth) AS (SELECT sample, component, id, id, -1, 0 FROM tl UNION ALL
      SELECT w.sample, w.component, w.start, k.b, w.node, w.depth + 1 FROM walk w JOIN both_ways k ON k.sample = w.sample AND k.a = w.node AND k.b <> w.prev)
    SELECT sample, CAST(component AS INT) AS component, max(depth) AS length FROM walk GROUP BY ALL""",
)
def _(t):
    edges = gr.cell_edges(t.grid.where("value > 0.15"), ["sample"])
    path = gr.longest_path(edges.select(cell_id().alias("a"), F.expr("sample * 64 + y2 * 8 + x2").alias("b")))
    ends = path.groupBy("component").agg(F.max("step").alias("length"))
    return ends.select(F.floor(F.col("component") / 64).alias("sample"), (F.col("component") % 64).cast("int").alias("component"), "length")


@query("g03_path_cells", "v_grid")
def _(t):
    edges = gr.cell_edges(t.grid.where("value > 0.15"), ["sample"])
    return gr.longest_path(edges.select(cell_id().alias("a"), F.expr("sample * 64 + y2 * 8 + x2").alias("b")))


@query(
    "a17_stability", "v_series",
    "SELECT vec_id, round(count(*) FILTER (value > 0.05 + 0.02) / nullif(count(*) FILTER (value > 0.05 - 0.02), 0), 6) AS stability FROM v_series GROUP BY vec_id",
)
def _(t):
    return ag.stability(t.series, ["vec_id"], "value", 0.05, 0.02).select("vec_id", r6("stability").alias("stability"))
