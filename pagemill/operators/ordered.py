"""Positions and ordered scans that stay balanced when one group holds most rows.

A plain ``Window.partitionBy(group)`` sends a whole group to one task. Here a
group is cut into chunks of neighbouring positions: windows run per
(group, chunk), each chunk leaves one summary row, and a second, tiny window over
the summaries tells every chunk what came before or after it.

Steps that follow each other on the same group and position can keep the chunk
column (``keep_chunk=True``): the rows are then shuffled once for all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pagemill.session import staged

CHUNK_ROWS = 1 << 16
WHOLE_GROUP_ROWS = 1 << 20
CHUNK = "_chunk"


def joined_back(rows: DataFrame, summary: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a summary back by the keys it was grouped by; null keys are a group as any other."""
    right = summary.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return rows.join(right, same, how).drop(*[f"_r_{k}" for k in keys])


CELLS = 1 << 18  # that groups are counted in first


def may_exceed(df: DataFrame, by: Sequence[str], limit: int) -> bool:
    """Can a group have more than ``limit`` rows? Counts hash cells of groups, so it moves few rows, however many groups there are."""
    cells = df.groupBy(F.pmod(F.xxhash64(*by), F.lit(CELLS)).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    return (cells.agg(F.max("_n")).first()[0] or 0) > limit


def large_groups(df: DataFrame, by: Sequence[str], limit: int, name: str = "large") -> DataFrame | None:
    """Keys of the groups of more than ``limit`` rows, staged; None where there are none, as in most tables.

    The count reads the group columns only, so that rows of small groups need not be written to tell them apart.
    """
    found = staged(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*by), name)
    return None if found.isEmpty() else found


def with_positions(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "pos", whole_group_rows: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in its group.

    ``order`` must be a total order inside a group. The largest group is measured first (a
    combined count that reads only the group columns, see ``may_exceed``). If it fits one task, a window
    numbers the rows. Otherwise rows are range-partitioned on (group, order), so a hot group
    spreads over many tasks, and a row's position is its number in its range plus the
    rows of the group in earlier ranges. Both ways give the same rows; null keys are a group.
    """
    by = list(by)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    limit = WHOLE_GROUP_ROWS if whole_group_rows is None else whole_group_rows
    if by:
        exact = lambda: df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
        if not may_exceed(df, by, limit) or exact() <= limit:
            return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    keys = [F.col(c) for c in by] + order
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # staged, because the bounds of the ranges are sampled and must be the same for both uses
    rows = staged(
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.spark_partition_id()),
        "positions",
    )
    if not by:
        by = ["_all"]
        rows = rows.withColumn("_all", F.lit(0))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*by, "_part")
        .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    return (
        joined_back(rows, starts, [*by, "_part"])
        .withColumn(name, F.col("_row") - F.col("_first") + F.col("_start"))
        .drop("_row", "_part", "_first", "_start", "_all")
    )


@dataclass(frozen=True)
class Scan:
    """One ordered computation.

    ``carry`` is its running value in a chunk, the current row included; on the far row of the
    chunk it is what the chunk hands on. ``join`` combines the handed-on value with the own one.
    """

    carry: Callable[[WindowSpec], Column]
    across: Callable[[Column, WindowSpec], Column]
    join: Callable[[Column, Column], Column]
    inclusive: bool
    backward: bool = False


_TO_HERE = (Window.unboundedPreceding, 0)
_EARLIER = (Window.unboundedPreceding, -1)


def before(value: Column, inclusive: bool = False) -> Scan:
    """Last non-null ``value`` of an earlier row (or this one)."""
    return Scan(
        lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(*_TO_HERE)),
        lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(*_EARLIER)),
        lambda here, there: F.coalesce(here, there),
        inclusive,
    )


def after(value: Column, inclusive: bool = False) -> Scan:
    """First non-null ``value`` of a later row (or this one); read backwards, as a growing frame."""
    return Scan(
        lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(*_TO_HERE)),
        lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(*_EARLIER)),
        lambda here, there: F.coalesce(here, there),
        inclusive,
        backward=True,
    )


def running_sum(value: Column, inclusive: bool = True) -> Scan:
    """Sum up to this row (or the one before). The value before a row equals the one up to
    its predecessor to the last bit, also across chunks."""
    zero = F.lit(0)
    return Scan(
        lambda w: F.sum(value).over(w.rowsBetween(*_TO_HERE)),
        lambda c, w: F.sum(c).over(w.rowsBetween(*_EARLIER)),
        lambda here, there: F.coalesce(here, zero) + F.coalesce(there, zero),
        inclusive,
    )


def running_max(value: Column, inclusive: bool = True) -> Scan:
    return Scan(
        lambda w: F.max(value).over(w.rowsBetween(*_TO_HERE)),
        lambda c, w: F.max(c).over(w.rowsBetween(*_EARLIER)),
        lambda here, there: F.greatest(here, there),
        inclusive,
    )


def _chunked(df: DataFrame, pos: str, chunk_rows: int | None) -> DataFrame:
    if CHUNK in df.columns:
        return df
    return df.withColumn(CHUNK, F.floor(F.col(pos) / (chunk_rows or CHUNK_ROWS)))


def scan(df: DataFrame, by: Sequence[str], pos: str, outputs: dict[str, Scan], chunk_rows: int | None = None, keep_chunk: bool = False) -> DataFrame:
    """Add the ``outputs`` columns, computed in order of the integer column ``pos``.

    ``pos`` has to be unique in a group. It need not be dense.
    """
    keys = [*by, CHUNK]
    rows = _chunked(df, pos, chunk_rows)
    kept = [c for c in rows.columns if c not in outputs and (c != CHUNK or keep_chunk)]

    def inside(s: Scan) -> WindowSpec:
        return Window.partitionBy(*keys).orderBy(F.desc(pos) if s.backward else F.asc(pos))

    def over_chunks(s: Scan) -> WindowSpec:
        return Window.partitionBy(*by).orderBy(F.desc(CHUNK) if s.backward else F.asc(CHUNK))

    local = rows.select("*", *[s.carry(inside(s)).alias(f"_c_{n}") for n, s in outputs.items()])
    far = lambda n, s: (F.min_by if s.backward else F.max_by)(f"_c_{n}", pos).alias(f"_s_{n}")
    summary = local.groupBy(*keys).agg(*[far(n, s) for n, s in outputs.items()])
    edge = summary.select(*keys, *[s.across(F.col(f"_s_{n}"), over_chunks(s)).alias(f"_e_{n}") for n, s in outputs.items()])
    # groups of one chunk have nothing handed on; without such rows Spark drops the join at run time
    edge = edge.where(" OR ".join(f"_e_{n} IS NOT NULL" for n in outputs))
    shifted = [
        (F.col(f"_c_{n}") if s.inclusive else F.lag(f"_c_{n}").over(inside(s))).alias(f"_l_{n}") for n, s in outputs.items()
    ]
    joined = joined_back(local.select("*", *shifted), edge, keys, "left")
    return joined.select(*kept, *[s.join(F.col(f"_l_{n}"), F.col(f"_e_{n}")).alias(n) for n, s in outputs.items()])


def _with_halo(df: DataFrame, pos: str, reach: int, size: int) -> DataFrame:
    """Copy rows near a chunk edge into the neighbouring chunk; ``_home`` is a row's own chunk."""
    home = F.floor(F.col(pos) / size)
    low, high = F.floor((F.col(pos) - reach) / size), F.floor((F.col(pos) + reach) / size)
    return df.withColumn("_home", home).withColumn(CHUNK, F.explode(F.sequence(low, high)))


def neighbours(
    df: DataFrame, by: Sequence[str], pos: str, prev: Sequence[str] = (), nxt: Sequence[str] = (),
    reach: int = 1, chunk_rows: int | None = None, keep_chunk: bool = False,
) -> DataFrame:
    """Add ``prev_<c>`` / ``next_<c>``: the values on the row before / after, nulls included.

    Only a row at most ``reach`` positions away is a neighbour; with dense positions the
    default finds every one. One shuffle: chunks carry copies of the rows next to them.
    """
    size = max(chunk_rows or CHUNK_ROWS, reach)
    rows = _with_halo(df.drop(CHUNK), pos, reach, size)
    w = Window.partitionBy(*by, CHUNK).orderBy(pos)
    near_prev = F.col(pos) - F.lag(pos).over(w) <= reach
    near_next = F.lead(pos).over(w) - F.col(pos) <= reach
    made = [F.when(near_prev, F.lag(c).over(w)).alias(f"prev_{c}") for c in prev]
    made += [F.when(near_next, F.lead(c).over(w)).alias(f"next_{c}") for c in nxt]
    out = rows.select("*", *made).where(F.col("_home") == F.col(CHUNK)).drop("_home")
    return out if keep_chunk else out.drop(CHUNK)


def rolling(df: DataFrame, by: Sequence[str], pos: str, radius: int, outputs: Callable[[WindowSpec], dict[str, Column]], chunk_rows: int | None = None) -> DataFrame:
    """Add columns over the rows whose ``pos`` lies within ``radius`` of the row's own. One shuffle."""
    rows = _with_halo(df, pos, radius, max(chunk_rows or CHUNK_ROWS, radius, 1))
    made = outputs(Window.partitionBy(*by, CHUNK).orderBy(pos).rangeBetween(-radius, radius))
    kept = [c for c in df.columns if c not in made]
    out = rows.select("*", *[c.alias(f"_o_{n}") for n, c in made.items()]).where(F.col("_home") == F.col(CHUNK))
    return out.select(*kept, *[F.col(f"_o_{n}").alias(n) for n in made])
