"""Grids and masks in long form: one row per cell ``(by..., y, x, value)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from pagemill.operators.folds import folded, nearest_in_grids, nearest_in_rows, sized
from pagemill.operators import folds
from pagemill.operators.ordered import after, before, joined_back, large_groups, neighbours, rolling, running_sum, scan
from pagemill.session import staged

KEY = "sample"


def grid_size(grid: DataFrame, by: str = KEY) -> DataFrame:
    return grid.groupBy(by).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))


def grid_sample(grid: DataFrame, places: DataFrame, place_id: Sequence[str], by: str = KEY, padding: str | float = "zeros") -> DataFrame:
    """Bilinear value of the grid at each place ``(v, u)`` in [0, 1], corners aligned.

    Outside cells count as 0, as a constant, or (``border``) as the nearest edge cell. A missing
    cell with some weight makes the value NULL. Every place asks for at most four cells.
    """
    rows = places.join(grid_size(grid, by), by)
    at_y, at_x = F.col("v") * (F.col("_h") - 1), F.col("u") * (F.col("_w") - 1)
    if padding == "border":
        at_y = F.greatest(F.lit(0.0), F.least(at_y, F.col("_h") - 1.0))
        at_x = F.greatest(F.lit(0.0), F.least(at_x, F.col("_w") - 1.0))
    rows = rows.withColumn("_py", at_y).withColumn("_px", at_x)
    fy, fx = F.col("_py") - F.floor("_py"), F.col("_px") - F.floor("_px")
    taps = F.array(*[
        F.struct(
            (F.floor("_py") + dy).cast("int").alias("y"), (F.floor("_px") + dx).cast("int").alias("x"),
            ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("_weight"),
        )
        for dy in (0, 1) for dx in (0, 1)
    ])
    asked = rows.select(by, *place_id, F.inline(taps)).where("_weight > 0")
    cells = grid.select(by, "y", "x", F.col("value").alias("_value"), F.lit(True).alias("_inside"))
    outside = F.lit(0.0 if isinstance(padding, str) else float(padding))
    found = asked.join(cells, [by, "y", "x"], "left")
    part = F.col("_weight") * F.when(F.col("_inside"), F.col("_value")).otherwise(outside)
    broken = F.count_if(F.col("_inside") & F.col("_value").isNull()) > 0
    return found.groupBy(by, *place_id).agg(F.when(~broken, F.sum(part)).alias("value"))


def grid_resize(grid: DataFrame, height: int, width: int, by: str = KEY) -> DataFrame:
    """Bilinear resize to ``height`` x ``width``, corners aligned."""
    rows = grid.select(by).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    cells = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    places = cells.select(by, F.col("y").alias("ty"), F.col("x").alias("tx"),
                          (F.col("y") / max(height - 1, 1)).alias("v"), (F.col("x") / max(width - 1, 1)).alias("u"))
    out = grid_sample(grid, places, ["ty", "tx"], by, "border")
    return out.select(by, F.col("ty").alias("y"), F.col("tx").alias("x"), "value")


def map_points(points: DataFrame, grid: DataFrame, point_id: Sequence[str], by: str = KEY) -> DataFrame:
    """Value of the grid at points ``(x, y)`` in [0, 1]; points outside get NULL."""
    inside = F.col("x").between(0, 1) & F.col("y").between(0, 1)
    places = points.where(inside).select(by, *point_id, F.col("y").alias("v"), F.col("x").alias("u"))
    return points.select(by, *point_id).join(grid_sample(grid, places, point_id, by, "border"), [by, *point_id], "left")


def grid_pool(grid: DataFrame, k: int, by: str = KEY) -> DataFrame:
    """Area mean over blocks of ``k`` x ``k`` cells."""
    at = lambda c: F.floor(F.col(c) / k).cast("int").alias(c)
    return grid.groupBy(by, at("y"), at("x")).agg(F.avg("value").alias("value"))


def map_error(a: DataFrame, b: DataFrame, by: str = KEY) -> DataFrame:
    """Mean absolute and mean squared difference over common cells."""
    gap = F.col("value") - F.col("_other")
    joined = a.join(b.select(by, "y", "x", F.col("value").alias("_other")), [by, "y", "x"])
    return joined.groupBy(by).agg(F.avg(F.abs(gap)).alias("l1"), F.avg(gap * gap).alias("mse"))


LEVEL_WEIGHTS = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)  # fixed values
STABILIZERS = (1e-4, 9e-4)  # fixed values


def ms_similarity(a: DataFrame, b: DataFrame, levels: int = 5, by: str = KEY) -> DataFrame:
    """Structural similarity over ``levels`` halvings, one window per level, weighted sum."""
    joined = a.select(by, "y", "x", F.col("value").alias("_a")).join(b.select(by, "y", "x", F.col("value").alias("_b")), [by, "y", "x"])
    # all levels are pooled in one shuffle: every cell names its block on each level
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    blocks = joined.withColumn("_l", level).groupBy(
        by, "_l", F.floor(F.col("y") / F.pow(F.lit(2.0), "_l")).alias("_y"), F.floor(F.col("x") / F.pow(F.lit(2.0), "_l")).alias("_x"),
    ).agg(F.avg("_a").alias("_a"), F.avg("_b").alias("_b"))
    c1, c2 = STABILIZERS
    stats = blocks.groupBy(by, "_l").agg(
        F.avg("_a").alias("ma"), F.avg("_b").alias("mb"), F.var_pop("_a").alias("va"), F.var_pop("_b").alias("vb"), F.covar_pop("_a", "_b").alias("cov")
    )
    ma, mb = F.col("ma"), F.col("mb")
    score = ((2 * ma * mb + c1) * (2 * F.col("cov") + c2)) / ((ma * ma + mb * mb + c1) * (F.col("va") + F.col("vb") + c2))
    weight = F.element_at(F.array(*[F.lit(w) for w in LEVEL_WEIGHTS]), F.col("_l") + 1)
    return stats.groupBy(by).agg(F.sum(weight * score).alias("similarity"))


def tight_crop(grid: DataFrame, mask: DataFrame, by: str = KEY, keep_last: bool = False) -> DataFrame:
    """Cut the grid to the extent of the mask; by default the last row and column are lost."""
    box = mask.groupBy(by).agg(F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.max("x").alias("_x1"))
    end = 1 if keep_last else 0
    rows = grid.join(box, by).where(
        (F.col("y") >= F.col("_y0")) & (F.col("y") < F.col("_y1") + end) & (F.col("x") >= F.col("_x0")) & (F.col("x") < F.col("_x1") + end)
    )
    return rows.select(by, (F.col("y") - F.col("_y0")).alias("y"), (F.col("x") - F.col("_x0")).alias("x"), "value")


def mask_boxes(cells: DataFrame, ids: DataFrame, by: Sequence[str], keep_empty: bool = True) -> DataFrame:
    """Box of the set cells of each mask; an empty mask gives zeros (or no row)."""
    boxes = cells.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    if not keep_empty:
        return boxes
    return ids.select(*by).distinct().join(boxes, list(by), "left").select(*by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def mask_overlap(a: DataFrame, b: DataFrame, by: Sequence[str], a_id: str, b_id: str) -> DataFrame:
    """IoU of masks that share a cell, and the share of ``a`` inside ``b``."""
    by = list(by)
    shared = a.join(b, [*by, "y", "x"]).groupBy(*by, a_id, b_id).agg(F.count(F.lit(1)).alias("_n"))
    size_a = a.groupBy(*by, a_id).agg(F.count(F.lit(1)).alias("_na"))
    size_b = b.groupBy(*by, b_id).agg(F.count(F.lit(1)).alias("_nb"))
    sized = shared.join(size_a, [*by, a_id]).join(size_b, [*by, b_id])
    return sized.select(*by, a_id, b_id, (F.col("_n") / (F.col("_na") + F.col("_nb") - F.col("_n"))).alias("iou"), (F.col("_n") / F.col("_na")).alias("inside"))


def slope_violations(grid: DataFrame, low: float, high: float, by: str = KEY) -> DataFrame:
    """Neighbour differences below ``low`` or above ``high`` along rows and columns."""

    def count(line: str, pos: str) -> DataFrame:
        rows = neighbours(grid.select(by, "y", "x", "value"), [by, line], pos, prev=["value"])
        diff = F.col("value") - F.col("prev_value")
        return rows.groupBy(by).agg(F.count_if(diff < low).alias("below"), F.count_if(diff > high).alias("above"))

    both = count("y", "x").unionByName(count("x", "y"))
    return both.groupBy(by).agg(F.sum("below").alias("below"), F.sum("above").alias("above"))


def smooth_grid(grid: DataFrame, k: int, identity: Column | None = None, by: str = KEY) -> DataFrame:
    """Mean over ``k`` x ``k`` cells of the displacement from ``identity``, which is added back.

    Done along x, then along y. At an edge the mean covers the cells in range.
    """
    base = identity if identity is not None else F.lit(0.0)
    rows = grid.select(by, "y", "x", (F.col("value") - base).alias("value"))
    r = k // 2
    rows = rolling(rows, [by, "y"], "x", r, lambda w: {"value": F.avg("value").over(w)})
    rows = rolling(rows, [by, "x"], "y", r, lambda w: {"value": F.avg("value").over(w)})
    return rows.withColumn("value", F.col("value") + base)


def gauss_smooth(df: DataFrame, sigma: float, by: Sequence[str], pos: str, value: str = "value") -> DataFrame:
    """Gaussian mean along the sequence, cut at four sigma; weights are renormalised at the ends."""
    radius = int(4 * sigma + 0.5)
    near = "_near"
    rows = rolling(df, by, pos, radius, lambda w: {near: F.collect_list(F.struct(pos, value)).over(w)})
    weight = lambda p: F.exp(-F.pow((p[pos] - F.col(pos)).cast("double"), F.lit(2.0)) / (2 * sigma * sigma))
    known = F.filter(near, lambda p: p[value].isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda s, p: s + weight(p) * p[value])
    norm = F.aggregate(known, F.lit(0.0), lambda s, p: s + weight(p))
    return rows.withColumn(value, total / F.nullif(norm, F.lit(0.0))).select(*df.columns)


def signal_extent(cells: DataFrame, by: str = KEY) -> DataFrame:
    """First and last column whose cell count, after a median over five columns, is not 0."""
    sums = cells.groupBy(by, "x").agg(F.sum("value").alias("_n"))
    rows = rolling(sums, [by], "x", 2, lambda w: {"_near": F.collect_list("_n").over(w)})
    padded = F.concat("_near", F.array_repeat(F.lit(0).cast("long"), 5 - F.size("_near")))
    median = F.get(F.array_sort(padded), 2)
    return rows.where(median != 0).groupBy(by).agg(F.min("x").alias("first_x"), F.max("x").alias("last_x"))


def column_runs(cells: DataFrame, gap: int = 2, step: int = 1, by: str = KEY, single_only: bool = False) -> DataFrame:
    """Runs of set cells per column; a step of more than ``gap`` starts a new run."""
    picked = cells.where(F.col("x") % step == 0).select(by, "x", "y")
    rows = neighbours(picked.withColumn("_y", F.col("y")), [by, "x"], "y", prev=["_y"], reach=gap, keep_chunk=True)
    breaks = F.when(F.col("y") - F.col("prev__y") <= gap, 0).otherwise(1)
    rows = scan(rows.withColumn("_break", breaks), [by, "x"], "y", {"run": running_sum(F.col("_break"))})
    runs = rows.groupBy(by, "x", "run").agg(F.min("y").alias("start"), F.max("y").alias("end"))
    runs = runs.withColumn("centre", F.floor((F.col("start") + F.col("end")) / 2).cast("int"))
    if not single_only:
        return runs
    lone = runs.groupBy(by, "x").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(by, "x")
    return runs.join(lone, [by, "x"], "left_semi")


def run_percentile(runs: DataFrame, share: float = 0.85, by: str = KEY) -> DataFrame:
    """Percentile (linear, cut to a whole number) of the number of runs per non-empty column."""
    counts = runs.groupBy(by, "x").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(by).agg(F.percentile("_n", share).cast("int").alias("runs"))


def rle_encode(mask: DataFrame, by: str = KEY) -> DataFrame:
    """Run lengths of a full mask ``(y, x, value 0/1)`` in column order: rows ``(run_no, count)``.

    Even runs are background; a mask that starts set gets a first run of length 0.
    """
    placed = mask.join(grid_size(mask, by), by).select(by, (F.col("x") * F.col("_h") + F.col("y")).cast("long").alias("_at"), "value")
    rows = neighbours(placed, [by], "_at", prev=["value"], keep_chunk=True)
    change = (F.col("value") != F.coalesce("prev_value", F.lit(0))).cast("int")
    rows = scan(rows.withColumn("_change", change), [by], "_at", {"run_no": running_sum(F.col("_change"))})
    runs = rows.groupBy(by, "run_no").agg(F.count(F.lit(1)).alias("count"))
    lead_in = runs.groupBy(by).agg(F.min("run_no").alias("_first")).where("_first > 0").select(by, F.lit(0).cast("long").alias("run_no"), F.lit(0).cast("long").alias("count"))
    return runs.unionByName(lead_in)


def rle_pack(runs: DataFrame, by: str = KEY) -> DataFrame:
    """Nest the runs of a mask for a document sink; a mask is one value there."""
    ordered = F.array_sort(F.collect_list(F.struct("run_no", "count")))
    return runs.groupBy(by).agg(F.transform(ordered, lambda r: r["count"]).alias("counts"))


def rle_unpack(df: DataFrame, by: str = KEY) -> DataFrame:
    return df.select(by, F.posexplode("counts").alias("run_no", "count"))


def rle_decode(runs: DataFrame, sizes: DataFrame, by: str = KEY) -> DataFrame:
    """Cells of a mask from its runs; ``sizes`` holds the height ``h`` per mask."""
    rows = scan(runs, [by], "run_no", {"_end": running_sum(F.col("count"))}).where("count > 0")
    at = F.explode(F.sequence(F.col("_end") - F.col("count"), F.col("_end") - 1))
    cells = rows.select(by, (F.col("run_no") % 2).cast("int").alias("value"), at.alias("_at")).join(sizes, by)
    return cells.select(by, (F.col("_at") % F.col("h")).cast("int").alias("y"), F.floor(F.col("_at") / F.col("h")).cast("int").alias("x"), "value")


def rle_area(counts: Column | str) -> Column:
    """Set cells of nested run lengths: the sum of the odd positions."""
    return F.aggregate(F.filter(counts, lambda c, i: i % 2 == 1), F.lit(0).cast("long"), lambda s, c: s + c)


def _fill_along(grid: DataFrame, by: Sequence[str], pos: str, name: str) -> DataFrame:
    """Linear inter- and extrapolation along one axis; lines with fewer than two values stay."""
    known = F.when(F.col("value").isNotNull(), F.struct(F.col(pos).alias("p"), F.col("value").alias("v")))
    rows = scan(grid, by, pos, {"_p1": before(known), "_n1": after(known)}, keep_chunk=True)
    left = F.when(F.col("value").isNotNull(), F.struct(F.col("_p1.p").alias("p"), F.col("_p1.v").alias("v")))
    right = F.when(F.col("value").isNotNull(), F.struct(F.col("_n1.p").alias("p"), F.col("_n1.v").alias("v")))
    rows = scan(rows, by, pos, {"_p2": before(left), "_n2": after(right)})

    def line(a: str, b: str) -> Column:
        slope = (F.col(f"{b}.v") - F.col(f"{a}.v")) / F.nullif((F.col(f"{b}.p") - F.col(f"{a}.p")).cast("double"), F.lit(0.0))
        return F.col(f"{a}.v") + slope * (F.col(pos) - F.col(f"{a}.p"))

    between = line("_p1", "_n1")
    value = F.coalesce(F.col("value"), between, F.when(F.col("_n1.v").isNull(), line("_p1", "_p2")), F.when(F.col("_p1.v").isNull(), line("_n1", "_n2")))
    return rows.withColumn(name, value).drop("_p1", "_n1", "_p2", "_n2")


def fill_grid(grid: DataFrame, by: str = KEY, passes: int | None = None) -> DataFrame:
    """Fill missing cells by the mean of the row and column fills, repeated until none is left.

    Rounds end early if a grid holds too few values to make progress. Values are cut to [0, 1].
    """
    live, done = grid.select(by, "y", "x", "value"), 0
    missing = None
    while True:
        rows = _fill_along(live, [by, "y"], "x", "_row")
        rows = _fill_along(rows, [by, "x"], "y", "_col")
        both = F.coalesce((F.col("_row") + F.col("_col")) / 2, F.col("_row"), F.col("_col"))
        live = rows.select(by, "y", "x", F.coalesce("value", both).alias("value"))
        done += 1
        if passes is not None and done >= passes:
            break
        live = staged(live, "filled")
        left = live.where("value IS NULL").count()
        if left == 0 or left == missing:
            break
        missing = left
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value")))
    return live.withColumn("value", F.when(F.col("value").isNotNull(), clipped))


def fill_nearest(grid: DataFrame, by: str = KEY) -> DataFrame:
    """Give missing cells the value of the nearest known cell (ties: least y, then x).

    Grids that fit a task are filled there, many at once. In larger ones every cell first learns the nearest known cell of its
    column, by a scan each way. Along a row, each column then stands
    for a parabola over x, and the lower envelope of a row's parabolas gives the nearest cell of all its missing cells in one pass
    inside a task. Rows with more cells than fit a task ask for columns within a growing radius instead, with the same result.
    """
    cells = grid.select(by, "y", "x", "value")
    large = large_groups(cells, [by], folds.FOLD_ROWS)
    small = (cells if large is None else joined_back(cells, large, [by], "left_anti")).withColumn("missing", F.col("value").isNull())
    whole = folded(small, [by], nearest_in_grids([by]), [by, "y", "x", "value", "missing"])
    value = F.col("value")
    if cells.schema["value"].dataType in (DoubleType(), FloatType()):
        value = F.coalesce(value, F.lit(float("nan")).cast(cells.schema["value"].dataType))  # tables of a fold have no other sign for null
    whole = whole.select(by, "y", "x", F.when(~F.col("missing"), value).alias("value"))
    return whole if large is None else whole.unionByName(_fill_large(joined_back(cells, large, [by], "left_semi"), by))


def _fill_large(cells: DataFrame, by: str) -> DataFrame:
    known = F.when(F.col("value").isNotNull(), F.struct(F.col("y").alias("y"), F.col("value").alias("value")))
    columns = scan(cells, [by, "x"], "y", {"_up": before(known, inclusive=True), "_down": after(known, inclusive=True)})
    up, down = F.col("y") - F.col("_up.y"), F.col("_down.y") - F.col("y")
    best = F.when(F.coalesce(up <= down, F.col("_up").isNotNull()), F.col("_up")).otherwise(F.col("_down"))
    columns = staged(columns.select(by, "y", "x", "value", best.alias("_near")), "columns")
    holes = columns.where("value IS NULL").select(by, "y").distinct()
    rows = joined_back(columns.select(by, "y", "x", F.col("value").isNull().alias("missing"), F.col("_near.y").alias("cy"), F.col("_near.value").alias("value")), holes, [by, "y"], "left_semi")
    small, large = sized(rows, [by, "y"], "rows")
    filled = folded(small.where("cy IS NOT NULL OR missing"), [by, "y"], nearest_in_rows([by, "y"]), [by, "y", "x", "value"])
    if not large.isEmpty():
        filled = filled.unionByName(_fill_rounds(large, by))
    joined = joined_back(cells, filled.withColumnRenamed("value", "_fill"), [by, "y", "x"], "left")
    return joined.select(by, "y", "x", F.coalesce("value", "_fill").alias("value"))


def _fill_rounds(rows: DataFrame, by: str) -> DataFrame:
    """Missing cells of long rows, by columns within a radius that doubles until the best distance lies inside it."""
    columns = rows.where("cy IS NOT NULL").select(by, "y", F.col("x").alias("_cx"), "cy", "value")
    open_cells = rows.where("missing").select(by, "y", "x")
    span = rows.agg(F.max("x") - F.min("x")).first()[0] or 0
    filled, radius = [], 1
    while True:
        asked = open_cells.withColumn("_cx", F.explode(F.sequence(F.col("x") - radius, F.col("x") + radius)))
        d2 = F.pow((F.col("x") - F.col("_cx")).cast("double"), F.lit(2.0)) + F.pow((F.col("y") - F.col("cy")).cast("double"), F.lit(2.0))
        options = joined_back(asked, columns, [by, "y", "_cx"])
        best = options.groupBy(by, "y", "x").agg(F.min(F.struct(d2.alias("d2"), "cy", "_cx", "value")).alias("_b"))
        last = radius >= span
        found = best if last else best.where(F.col("_b.d2") <= float(radius * radius))
        found = staged(found.select(by, "y", "x", F.col("_b.value").alias("value")), "found")
        filled.append(found)
        if last:
            break
        open_cells = staged(open_cells.join(found.select(by, "y", "x"), [by, "y", "x"], "left_anti"), "open")
        if open_cells.isEmpty():
            break
        radius *= 2
    fills = filled[0]
    for more in filled[1:]:
        fills = fills.unionByName(more)
    return fills
