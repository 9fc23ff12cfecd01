"""Nearest target per query without comparing every pair of a group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.scalars import box_distance
from pagemill.operators.ordered import joined_back, large_groups
from pagemill.session import staged

BOX = ("x0", "y0", "x1", "y1")
TARGETS_PER_CELL = 512
GROUP_TARGETS = 64  # of a group with at most so many, a query is held against every one
PARTS = 64  # columns of a group, and rows of a column, at most
FRACTIONS = [k / PARTS for k in range(1, PARTS)]


def _edges(quantiles: str, count: str, power: int) -> Column:
    """Distinct inner edges that cut ``count`` targets into parts of about the wanted size."""
    n = F.least(F.lit(PARTS), F.ceil(F.pow(F.col(count) / TARGETS_PER_CELL, 1 / power))).cast("int")
    picked = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.element_at(quantiles, F.floor(k * PARTS / n).cast("int")))
    return F.when(n > 1, F.array_distinct(picked)).otherwise(F.array().cast("array<double>"))


def _cell(value: str, edges: str) -> Column:
    return F.size(F.filter(edges, lambda e: e <= F.col(value)))


def nearest(
    queries: DataFrame,
    targets: DataFrame,
    by: Sequence[str],
    query_id: Sequence[str],
    target_id: Sequence[str],
    distance: Callable[[], Column] | None = None,
    keep: Sequence[str] = (),
    counted: DataFrame | None = None,
) -> DataFrame:
    """For every query box the target with the least distance; ties go to the least id.

    Both sides carry box columns (queries ``qx0..qy1``, targets ``x0..y1``; points have
    equal corners). In a group of few targets every query meets all of them, by one join on the group. Targets of larger groups are
    cut into columns at quantiles of x and each column at quantiles of y, so cells hold about
    as many targets wherever they lie. Both sides are summarised by cell first. A target cell is opened for a query only
    if its lower distance bound does not exceed the least upper bound over all cells, so
    the answer is exact while most targets of a large group are never compared.
    ``distance`` may refine the box distance; it must not be smaller than it, nor
    exceed the distance to the farthest corner of the target box. Rows carry the box of the query, too.
    Groups are told apart by the rows of ``counted``, where that is given: a table with no fewer rows in a group than targets.
    """
    by, query_id, target_id = list(by), list(query_id), list(target_id)
    q = [F.col(f"q{c}") for c in BOX]
    exact = distance() if distance else box_distance(q, BOX)

    def best_of(pairs: DataFrame) -> DataFrame:
        best = F.min(F.struct(exact.alias("_d"), *target_id, F.struct(*BOX, *keep, *q).alias("_t"))).alias("_best")
        return pairs.groupBy(*by, *query_id).agg(best).select(
            *by, *query_id, F.col("_best._d").alias("distance"), *[F.col(f"_best.{c}").alias(c) for c in target_id],
            *[F.col(f"_best._t.{c}").alias(c) for c in (*BOX, *keep, *[f"q{c}" for c in BOX])],
        )

    large = large_groups(targets if counted is None else counted, by, min(GROUP_TARGETS, TARGETS_PER_CELL))
    if large is None:
        return best_of(queries.join(targets, by))
    small = best_of(joined_back(queries, large, by, "left_anti").join(joined_back(targets, large, by, "left_anti"), by))
    # each side is read several times below, so it is computed once
    queries, targets = [staged(joined_back(side, large, by, "left_semi"), name) for side, name in ((queries, "queries"), (targets, "targets"))]
    return small.unionByName(best_of(_met(queries, targets, by, query_id)))


def _met(queries: DataFrame, targets: DataFrame, by: list[str], query_id: list[str]) -> DataFrame:
    """Pairs of each query and the targets of the cells that may hold its nearest one."""
    q = [F.col(f"q{c}") for c in BOX]
    x_edges = targets.groupBy(*by).agg(F.percentile_approx("x0", FRACTIONS).alias("_e"), F.count(F.lit(1)).alias("_c"))
    x_edges = staged(x_edges.select(*by, _edges("_e", "_c", 2).alias("_xe"), "_c"), "columns")
    columns = targets.join(x_edges, by).select(*targets.columns, _cell("x0", "_xe").alias("_cx"))
    y_edges = columns.groupBy(*by, "_cx").agg(F.percentile_approx("y0", FRACTIONS).alias("_e"), F.count(F.lit(1)).alias("_c"))
    y_edges = staged(y_edges.select(*by, "_cx", _edges("_e", "_c", 1).alias("_ye")), "rows")
    placed = columns.join(y_edges, [*by, "_cx"]).select(*targets.columns, "_cx", _cell("y0", "_ye").alias("_cy"))
    cells = placed.groupBy(*by, "_cx", "_cy").agg(*[(F.min if c in ("x0", "y0") else F.max)(c).alias(f"_{c}") for c in BOX])

    # queries are grouped the same way, so that those of a region look at the same cells
    asked = queries.join(x_edges, by).select(*queries.columns, _cell("qx0", "_xe").alias("_qx"))
    near_rows = y_edges.withColumnRenamed("_cx", "_qx")
    asked = asked.join(near_rows, [*by, "_qx"], "left").select(*queries.columns, "_qx", F.coalesce(_cell("qy0", "_ye"), F.lit(0)).alias("_qy"))
    regions = asked.groupBy(*by, "_qx", "_qy").agg(*[(F.min if c in ("x0", "y0") else F.max)(f"q{c}").alias(f"_r{c}") for c in BOX])

    def bounds(box: list[Column]) -> tuple[Column, Column]:
        c = [F.col(f"_{n}") for n in BOX]
        spread = [F.greatest(*[F.abs(c[k] - box[m]) for k in (axis, axis + 2) for m in (axis, axis + 2)]) for axis in (0, 1)]
        return box_distance(box, c), F.sqrt(spread[0] * spread[0] + spread[1] * spread[1])

    def within_reach(pairs: DataFrame, box: list[Column], keys: list[str]) -> DataFrame:
        low, high = bounds(box)
        pairs = pairs.withColumn("_low", low).withColumn("_high", high)
        reach = pairs.groupBy(*by, *keys).agg(F.min("_high").alias("_reach"))
        return pairs.join(reach, [*by, *keys]).where("_low <= _reach").drop("_low", "_high", "_reach")

    # first cell against cell, then each query against the cells left for its own cell
    near = within_reach(regions.join(cells, by), [F.col(f"_r{c}") for c in BOX], ["_qx", "_qy"])
    near = near.select(*by, "_qx", "_qy", "_cx", "_cy", *[f"_{c}" for c in BOX])
    opened = within_reach(asked.join(near, [*by, "_qx", "_qy"]), q, query_id).select(*queries.columns, "_cx", "_cy")

    return opened.join(placed, [*by, "_cx", "_cy"])
