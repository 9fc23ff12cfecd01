"""Graph operators as rounds of joins over all groups at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators import folds
from pagemill.operators.folds import drop_steep, drop_worse, folded, longest_paths, sized
from pagemill.operators.ordered import joined_back, large_groups, neighbours, running_sum, scan, with_positions
from pagemill.session import forget, staged

CONTRACT_ROWS = 1 << 19


def least_connected(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the least node that the edges connect it to."""
    label = np.arange(n)
    while True:
        lu, lv = label[u], label[v]
        if np.array_equal(lu, lv):
            return label
        np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
        while not np.array_equal(label, label[label]):
            label = label[label]


def _stars(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Replace edges by (node, least node connected by them)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = least_connected(flat[: len(a)], flat[len(a):], len(nodes))
    moved = label != np.arange(len(nodes))
    return pd.DataFrame({"u": nodes[moved], "v": nodes[label[moved]]})


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= CONTRACT_ROWS:
            whole = pd.concat(held)
            yield _stars(whole["u"].to_numpy(), whole["v"].to_numpy())
            held, size = [], 0
    if size:
        whole = pd.concat(held)
        yield _stars(whole["u"].to_numpy(), whole["v"].to_numpy())


def _contracted(edges: DataFrame) -> DataFrame:
    """Stars of ``edges`` (staged, ``u, v``): neighbouring ids meet in one task, few edges in a single one."""
    n = edges.count()
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = 1 if n <= CONTRACT_ROWS // 8 else max(parts, n // CONTRACT_ROWS + 1)
    low, high = F.least("u", "v"), F.greatest("u", "v")
    dealt = edges.coalesce(1) if tasks == 1 else edges.repartitionByRange(tasks, low, high)
    return staged(dealt.sortWithinPartitions(low, high).mapInPandas(_contract, "u long, v long").distinct(), "stars")


def _unsettled(stars: DataFrame) -> DataFrame:
    """Ids that point at two roots, or at one while others point at them: the places where stars of several tasks meet."""
    ends = F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("root")), F.struct(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("root")))
    return stars.select(F.inline(ends)).groupBy("id").agg(F.sum("out").alias("out"), F.max("root").alias("root")).where("out > 1 OR (out > 0 AND root > 0)").select("id")


def _star_round(live: DataFrame) -> DataFrame:
    """One large-star and one small-star step; keeps all ids and their components."""
    both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    small_least = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Label every node ``id`` with the least id it is connected to; edges are ``(a, b)`` of bigint.

    Edges are dealt by ranges of ids and contracted to stars inside their task. Where ids of one sample lie together, as
    packed ids do, nearly all components end there. Stars of different tasks meet in single ids only: the next
    level sees just the edges of those ids, which a last task solves as soon as they are few. If a level does not halve the edges, a
    large-star and a small-star step go before the next one, so that a giant component takes a logarithmic number
    of levels. Then every level's roots are looked up in the level above.
    """
    live = staged(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"), "edges")
    levels: list[DataFrame] = []
    while True:
        stars = _contracted(live)
        levels.append(stars)
        unsettled = staged(_unsettled(stars), "unsettled")
        if unsettled.isEmpty():
            break
        rest = staged(stars.join(unsettled.withColumnRenamed("id", "u"), "u", "left_semi"), "edges")
        if 2 * rest.count() > live.count():
            slow, rest = rest, staged(_star_round(rest), "edges")
            forget(slow)
        forget(live)
        forget(unsettled)
        live = rest
    roots = levels.pop()
    while levels:
        above = roots.select(F.col("u").alias("v"), F.col("v").alias("_root"))
        looked_up = levels.pop().join(above, "v", "left").select("u", F.coalesce("_root", "v").alias("v"))
        roots = looked_up.unionByName(roots).distinct()  # a root of this level may have a root above only
    roots = roots.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


OFFSETS = [(-1, 1), (0, 1), (1, 0), (1, 1)]  # fixed values: (dy, dx) to the neighbours listed once per pair


def cell_edges(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Edges between set cells that touch, also at a corner: ``(by, y, x, y2, x2)``."""
    steps = F.array(*[F.struct((F.col("y") + dy).alias("y2"), (F.col("x") + dx).alias("x2")) for dy, dx in OFFSETS])
    around = cells.select(*by, "y", "x", F.inline(steps))
    other = cells.select(*by, F.col("y").alias("y2"), F.col("x").alias("x2"))
    return around.join(other, [*by, "y2", "x2"]).select(*by, "y", "x", "y2", "x2")


def largest_component(labels: DataFrame, by: Sequence[str], label: str = "component") -> DataFrame:
    """Cells of the biggest component of each group (ties: least label)."""
    sizes = labels.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    best = sizes.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(label).alias("c"))).alias("_b"))
    return labels.join(best.select(*by, F.col("_b.c").alias(label)), [*by, label], "left_semi")


def _tour(both: DataFrame) -> DataFrame:
    """A walk around each tree, as places of its edges: ``(component, a, b, there, back, n)`` with ``a < b``.

    ``both`` lists every edge both ways. From x to y the walk goes on to the neighbour of y that follows x, in a circle, and so passes
    every edge once each way. It starts with the first edge of the least node. A step's place is told by the number of steps after it: in
    each round a step looks as far ahead again as it could see so far, so n steps take log2(n) rounds whatever the tree's shape.
    """
    around = staged(neighbours(with_positions(both, ["a"], ["b"], "_pos"), ["a"], "_pos", nxt=["b"]), "around")
    first = around.where("_pos = 0").select("a", F.col("b").alias("_first"))
    onward = F.coalesce("next_b", "_first")
    ends = (F.col("a") == F.col("component")) & (onward == F.col("_first"))
    walk = staged(around.join(first, "a").select(
        "component", F.col("b").alias("x"), F.col("a").alias("y"), F.when(~ends, F.col("a")).alias("next_x"), F.when(~ends, onward).alias("next_y"),
        F.when(ends, 0).otherwise(1).cast("long").alias("left"),
    ), "walk")
    while True:
        going = walk.where("next_x IS NOT NULL")
        if going.isEmpty():
            break
        ahead = walk.select(F.col("x").alias("next_x"), F.col("y").alias("next_y"), F.col("next_x").alias("_x"), F.col("next_y").alias("_y"), F.col("left").alias("_more"))
        jumped = going.join(ahead, ["next_x", "next_y"]).select("component", "x", "y", F.col("_x").alias("next_x"), F.col("_y").alias("next_y"), (F.col("left") + F.col("_more")).alias("left"))
        last, walk = walk, staged(walk.where("next_x IS NULL").unionByName(jumped), "walk")
        forget(last)
    n = walk.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    up = F.col("x") < F.col("y")
    edges = walk.groupBy("component", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
        F.max(F.when(up, F.col("left"))).alias("_there"), F.max(F.when(~up, F.col("left"))).alias("_back"))
    place = lambda c: F.col("n") - 1 - F.col(c)
    return staged(edges.join(n, "component").select("component", "a", "b", place("_there").alias("there"), place("_back").alias("back"), "n"), "tour")


def _depths(tour: DataFrame, starts: DataFrame) -> DataFrame:
    """Distance of every node from the start of its tree: ``(component, node, depth)``.

    The walk is a circle, so turning it makes it begin at any node. Of an edge's two places the earlier one leads down, to a new
    node; a node's depth is the number of steps down less the number of steps up so far.
    """
    leaving = F.when(F.col("a") == F.col("node"), F.col("there")).when(F.col("b") == F.col("node"), F.col("back"))
    begin = tour.join(starts.select("component", "node"), "component").groupBy("component").agg(F.min(leaving).alias("_begin"))
    turned = lambda c: F.pmod(F.col(c) - F.col("_begin"), F.col("n"))
    rows = tour.join(begin, "component").select("component", "a", "b", turned("there").alias("_there"), turned("back").alias("_back"))
    below = F.when(F.col("_there") < F.col("_back"), F.col("b")).otherwise(F.col("a"))
    down = F.struct(F.least("_there", "_back").alias("at"), F.lit(1).alias("step"), below.alias("node"))
    up = F.struct(F.greatest("_there", "_back").alias("at"), F.lit(-1).alias("step"), F.lit(None).cast("long").alias("node"))
    walk = scan(rows.select("component", F.inline(F.array(down, up))), ["component"], "at", {"depth": running_sum(F.col("step"))})
    found = walk.where("node IS NOT NULL").select("component", "node", F.col("depth").cast("int").alias("depth"))
    return found.unionByName(starts.select("component", "node", F.lit(0).alias("depth")))


def _farthest(depths: DataFrame) -> DataFrame:
    best = depths.groupBy("component").agg(F.min(F.struct((-F.col("depth")).alias("d"), "node")).alias("_b"))
    return best.select("component", F.col("_b.node").alias("node"), (-F.col("_b.d")).alias("length"))


def longest_path(edges: DataFrame) -> DataFrame:
    """Nodes of the longest path of every tree: ``(component, step, node, length)``; cycles give nothing.

    Trees that fit a task are walked there, larger ones by a tour found in a logarithmic number of rounds. Ties between ends go to the
    lesser node.
    """
    once = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "tree")
    nodes = once.select(F.col("a").alias("id")).unionByName(once.select(F.col("b").alias("id"))).distinct()
    labels = staged(components(nodes, once), "labels")
    size = labels.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    links = once.join(labels, F.col("a") == F.col("id")).groupBy("component").agg(F.count(F.lit(1)).alias("_e"))
    trees = size.join(links, "component").where("_e < _n").select("component")
    kept = once.join(labels, F.col("a") == F.col("id")).join(trees, "component", "left_semi").select("component", "a", "b")
    edge = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = kept.select("component", F.inline(F.array(edge("a", "b"), edge("b", "a"))))
    small, large = sized(both.withColumn("step", F.lit(0)).withColumn("node", F.lit(0).cast("long")).withColumn("length", F.lit(0)), ["component"], "tree")
    short = folded(small, ["component"], longest_paths, ["component", "step", "node", "length"])
    if large.isEmpty():
        return short
    return short.unionByName(_longest_by_tour(large.select("component", "a", "b"), large.select("component").distinct()))


def _longest_by_tour(both: DataFrame, trees: DataFrame) -> DataFrame:
    """All trees together, by one walk around each of them. On a tree the path between its two far ends is made of the nodes whose
    distances to both ends add up to its length.
    """
    tour = _tour(both)
    one_end = staged(_farthest(_depths(tour, trees.select("component", F.col("component").alias("node")))), "ends")
    from_one = staged(_depths(tour, one_end), "depths")
    other_end = staged(_farthest(from_one), "ends")
    from_other = _depths(tour, other_end).withColumnRenamed("depth", "_back")
    path = from_one.join(from_other, ["component", "node"]).join(other_end.select("component", "length"), "component")
    return path.where("depth + _back = length").select("component", F.col("depth").alias("step"), "node", "length")


def suppress(items: DataFrame, conflicts: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """Greedy choice, best first: ``conflicts(by, better, worse)`` says who may drop whom.

    Groups whose conflicts fit a task are decided there in one pass; larger groups are split into parts that share no
    conflict, and those that fit are decided likewise. Of larger parts, a round keeps every item without a live better rival
    and drops the losers to it.
    """
    by = list(by)
    columns = [*by, "better", "worse"]
    small, large = sized(conflicts.select(*columns), by, "rivals")
    dropped = folded(small, by, drop_worse(by), [*by, "worse"])
    if not large.isEmpty():
        # a large group falls into parts that share no rival; only a part beyond the limit goes in rounds
        parts, large = sized(with_component(large, by, "better", "worse", one_kind=True), [*by, COMPONENT], "rivals")
        dropped = dropped.unionByName(folded(parts, [*by, COMPONENT], drop_worse(by), [*by, "worse"]))
    items = items.join(staged(dropped.withColumnRenamed("worse", item), "dropped"), [*by, item], "left_anti")
    return items if large.isEmpty() else _suppress_rounds(items, large.select(*columns), by, item)


COMPONENT = "_component"


def with_component(pairs: DataFrame, by: Sequence[str], a: str, b: str, one_kind: bool) -> DataFrame:
    """``pairs`` with the number of the connected part of their group they belong to.

    With ``one_kind`` both columns name the same items; without, an item of ``a`` and one of ``b`` are never the same. Items are numbered
    in order of group and item, so that ``components`` finds the items of a part in one place.
    """
    by = list(by)
    ends = [pairs.select(*by, F.lit(0 if one_kind else k).alias("_kind"), F.col(c).alias("_item")).distinct() for k, c in enumerate((a, b))]
    if one_kind:
        ends = [ends[0].unionByName(ends[1]).distinct()] * 2
    numbered = [staged(with_positions(e, [], [*by, "_item"], "_id"), "items") for e in (ends[:1] if one_kind else ends)]
    left, right = numbered[0], numbered[-1]
    kinds = 1 if one_kind else 2
    out = joined_back(pairs, left.select(*by, F.col("_item").alias(a), (F.col("_id") * kinds).alias("_a")), [*by, a])
    out = staged(joined_back(out, right.select(*by, F.col("_item").alias(b), (F.col("_id") * kinds + (kinds - 1)).alias("_b")), [*by, b]), "numbered")
    labels = components(out.select(F.col("_a").alias("id")), out.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    return out.join(labels.select(F.col("id").alias("_a"), F.col("component").alias(COMPONENT)), "_a").drop("_a", "_b")


def _suppress_rounds(items: DataFrame, rivals: DataFrame, by: list[str], item: str) -> DataFrame:
    alive = staged(items.select(*by, item), "alive")
    kept = []
    while True:
        threatened = rivals.select(*by, F.col("worse").alias(item)).distinct()
        keepers = staged(alive.join(threatened, [*by, item], "left_anti"), "keepers")
        kept.append(keepers)
        if rivals.isEmpty():
            break
        better = keepers.withColumnRenamed(item, "better")
        losers = rivals.join(better, [*by, "better"], "left_semi").select(*by, F.col("worse").alias(item)).distinct()
        gone = staged(keepers.unionByName(losers), "gone")
        last, alive = alive, staged(alive.join(gone, [*by, item], "left_anti"), "alive")
        forget(last)
        last, rivals = rivals, staged(
            rivals.join(gone.withColumnRenamed(item, "better"), [*by, "better"], "left_anti")
            .join(gone.withColumnRenamed(item, "worse"), [*by, "worse"], "left_anti"), "rivals",
        )
        forget(last)
        forget(gone)
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return items.join(out, [*by, item], "left_semi")


def eliminate(df: DataFrame, by: Sequence[str], low: float, high: float) -> DataFrame:
    """Remove points one by one while that lowers the number of slope violations.

    ``df`` has ``(by, seq, x, y)``. A point's gain is the drop in violations if it goes; the greatest gain goes first, ties to
    the earlier point. No point goes without a gain, not even the first. Lines that do not fit a task are cut into independent
    stretches; only a stretch that does not fit either goes in rounds.
    """
    by = list(by)
    columns = [*by, "seq", "x", "y"]
    df = df.select(*columns)
    many = large_groups(df, by, folds.FOLD_ROWS)
    kept = folded(df if many is None else joined_back(df, many, by, "left_anti"), by, drop_steep(by, low, high), columns)
    if many is None:
        return kept
    rows = staged(_stretches(staged(joined_back(df, many, by, "left_semi"), "points"), by, low, high), "stretches")
    fixed = rows.where("_free = 0").select(*columns).distinct()
    stretch = [*by, "_stretch"]
    small, large = sized(rows.where("_stretch IS NOT NULL"), stretch, "points")
    some = folded(small, stretch, drop_steep(stretch, low, high), [*columns, "_free"])
    if not large.isEmpty():
        left = _eliminate_rounds(large.select(*stretch, "seq", "x", "y"), stretch, low, high)
        some = some.unionByName(joined_back(left, large.select(*stretch, "seq", "_free"), [*stretch, "seq"]).select(*columns, "_free"))
    return kept.unionByName(fixed).unionByName(some.where("_free = 1").select(*columns))


def _bad(dx: Column, dy: Column, low: float, high: float) -> Column:
    slope = dy / F.nullif(dx, F.lit(0.0))
    return F.coalesce(((slope < low) | (slope > high)).cast("int"), F.lit(0))


def _stretches(df: DataFrame, by: list[str], low: float, high: float) -> DataFrame:
    """Cut lines at points that can never go: ``(by, seq, x, y, _free, _stretch)``.

    A point goes only if a steep step touches it, and the step that closes the gap is steep only if both steps before were. So a point
    between two steps that are not steep stays for good, and its steps stay as they are: what goes on its two sides
    is independent. Such points (``_free`` = 0) end the stretches on either side and are listed with each of them, with a null
    stretch where no free point is next to them.
    """
    rows = with_positions(df, by, ["seq"], "_pos")
    rows = neighbours(rows, by, "_pos", prev=["x", "y"], nxt=["x", "y"])
    steep = _bad(F.col("x") - F.col("prev_x"), F.col("y") - F.col("prev_y"), low, high) + _bad(F.col("next_x") - F.col("x"), F.col("next_y") - F.col("y"), low, high)
    rows = rows.withColumn("_free", (steep > 0).cast("int")).select(*by, "seq", "x", "y", "_pos", "_free")
    rows = scan(rows, by, "_pos", {"_ends": running_sum(1 - F.col("_free"))})
    rows = neighbours(rows, by, "_pos", prev=["_free"], nxt=["_free"])
    none = F.lit(None).cast("long")
    ends = F.col("_ends").cast("long")
    beside = F.array(F.when(F.col("next__free") == 1, ends).otherwise(none), F.when(F.col("prev__free") == 1, ends - 1).otherwise(none))
    at = F.when(F.col("_free") == 1, F.array(ends)).otherwise(beside)
    return rows.select(*by, "seq", "x", "y", "_free", F.explode(at).alias("_stretch"))


def _eliminate_rounds(df: DataFrame, by: list[str], low: float, high: float) -> DataFrame:
    """A gain only depends on a point's neighbours, and removing a point only changes the gains of the two
    points on each side. So a round removes all points whose gain beats (ties: earlier
    first) every gain within two places; the order among those cannot matter.
    """

    def bad(dx: Column, dy: Column) -> Column:
        return _bad(dx, dy, low, high)

    live = staged(df.select(*by, "seq", "x", "y"), "points")
    while True:
        rows = with_positions(live, by, ["seq"], "_pos")
        rows = neighbours(rows, by, "_pos", prev=["x", "y"], nxt=["x", "y"])
        here_prev = bad(F.col("x") - F.col("prev_x"), F.col("y") - F.col("prev_y"))
        here_next = bad(F.col("next_x") - F.col("x"), F.col("next_y") - F.col("y"))
        joined = bad(F.col("next_x") - F.col("prev_x"), F.col("next_y") - F.col("prev_y"))
        rows = rows.withColumn("gain", here_prev + here_next - joined).select(*by, "seq", "x", "y", "_pos", "gain")
        gains = staged(rows, "gains")
        useful = gains.where("gain > 0")
        if useful.isEmpty():
            return live
        near = useful.select(*by, "_pos", "gain").withColumn("_at", F.explode(F.sequence(F.col("_pos") - 2, F.col("_pos") + 2)))
        beaten = near.groupBy(*by, "_at").agg(F.min(F.struct((-F.col("gain")).alias("g"), F.col("_pos").alias("p"))).alias("_b"))
        chosen = useful.join(beaten.withColumnRenamed("_at", "_pos"), [*by, "_pos"]).where(F.col("_b.p") == F.col("_pos"))
        last, live = live, staged(live.join(chosen.select(*by, "seq"), [*by, "seq"], "left_anti"), "points")
        forget(last)
        forget(gains)


def label_corners(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Name four ring points (``seq`` 0..3) after the corners of their bounding box.

    Of the four shifts in both directions the one with the least total distance wins.
    """
    by = list(by)
    box = df.groupBy(*by).agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.max("x").alias("_x1"), F.max("y").alias("_y1"))
    orders = F.explode(F.array(*[F.struct(F.lit(s).alias("shift"), F.lit(d).alias("way")) for d in (1, -1) for s in range(4)]))
    tried = df.join(box, by).withColumn("_o", orders)
    corner = F.pmod(F.col("_o.shift") + F.col("_o.way") * F.col("seq"), F.lit(4))
    cx = F.when(corner.isin(0, 3), F.col("_x0")).otherwise(F.col("_x1"))
    cy = F.when(corner.isin(0, 1), F.col("_y0")).otherwise(F.col("_y1"))
    scored = tried.groupBy(*by, "_o").agg(F.sum(F.hypot(F.col("x") - cx, F.col("y") - cy)).alias("_d"))
    best = scored.groupBy(*by).agg(F.min(F.struct(F.round("_d", 9).alias("d"), (-F.col("_o.way")).alias("w"), F.col("_o.shift").alias("s"))).alias("_b"))
    names = F.array(*[F.lit(n) for n in ("top_left", "top_right", "bottom_right", "bottom_left")])
    place = F.pmod(F.col("_b.s") - F.col("_b.w") * F.col("seq"), F.lit(4))
    return df.join(best, by).select(*by, "seq", "x", "y", F.element_at(names, (place + 1).cast("int")).alias("corner"))
