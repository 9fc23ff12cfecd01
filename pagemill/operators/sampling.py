"""Seeded sampling and training-set assembly.

Every random choice is a hash of seed and key, so it does not depend on how rows are
partitioned, and a lost task makes the same choice again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.ordered import with_positions
from pagemill.operators.polylines import blended, line_arrays
from pagemill.session import staged


def uniform(seed: int, *keys: str | Column) -> Column:
    """Number in [0, 1) from the seed and the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / float(1 << 53)


def shuffle(df: DataFrame, by: Sequence[str], key: Sequence[str], seed: int, name: str = "rank") -> DataFrame:
    """Seeded random position of each row in its group."""
    return with_positions(df.withColumn("_u", F.xxhash64(F.lit(seed), *key)), by, ["_u", *key], name).drop("_u")


def subsample_pairs(df: DataFrame, by: Sequence[str], item: str, n: int, ratio: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Choose ``n`` items per side: pairs shared by both sides, the rest different on each side.

    Pairs: ``max(2n - available, ceil(n * ratio))``. Rows ``(by, item, role, rank)`` with role ``pair``, ``a``
    or ``b``. The second table tells the groups with fewer than ``n`` items: ``(by, available)``.
    """
    by = list(by)
    counted = staged(df.groupBy(*by).agg(F.countDistinct(item).alias("_n")), "sizes")
    sizes, few = counted.where(F.col("_n") >= n), counted.where(F.col("_n") < n)
    rows = shuffle(df.select(*by, item).distinct(), by, [item], seed).join(sizes, by)
    pairs = F.greatest(2 * n - F.col("_n"), F.ceil(F.lit(n * ratio)))
    rank = F.col("rank")
    role = F.when(rank < pairs, "pair").when(rank < n, "a").when(rank < n + (n - pairs), "b")
    return rows.withColumn("role", role).where("role IS NOT NULL").select(*by, item, "role", "rank"), few.withColumnRenamed("_n", "available")


P1, P2, P3, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _draws(start: np.ndarray, number: np.ndarray) -> np.ndarray:
    """``uniform`` of keys that end in an int: ``start`` is the hash of all before it."""
    h = start.view(np.uint64) + P5 + np.uint64(4)
    h ^= number.astype(np.uint64) * P1
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * P2 + P3
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return ((h ^ (h >> np.uint64(32))) & np.uint64((1 << 53) - 1)) / float(1 << 53)


def _numbered(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of every character of texts of these sizes, and its number in the text."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.array([len(t) for t in texts], dtype=np.int64)


def mutate_text(text: str | Column, key: Sequence[str | Column], rate: float, alphabet: str, seed: int) -> Column:
    """Insert, then delete, then substitute characters, each with probability ``rate``.

    The hash of seed, key and step is one value of the text; from it the draws of all characters of a batch of texts follow at once.
    """
    letters = _code_points([alphabet])[0]

    @F.pandas_udf("string")
    def mutated(texts: pd.Series, insert: pd.Series, insert_letter: pd.Series, delete: pd.Series, substitute: pd.Series, substitute_letter: pd.Series) -> pd.Series:
        known = texts.notna().to_numpy()
        # the blank at the end lets a character be inserted after the last one
        chars, size = _code_points([t + " " for t in texts[known]])
        starts = [np.ascontiguousarray(h.to_numpy()[known], dtype=np.int64) for h in (insert, insert_letter, delete, substitute, substitute_letter)]

        def hit(step: int, row: np.ndarray, at: np.ndarray) -> np.ndarray:
            return _draws(starts[step][row], at) <= rate

        def pick(step: int, row: np.ndarray, at: np.ndarray) -> np.ndarray:
            return letters[(_draws(starts[step][row], at) * len(letters)).astype(np.int64)]

        row, at = _numbered(size)
        new = hit(0, row, at)
        place = np.arange(len(chars)) + np.cumsum(new)
        grown, kept = np.empty(len(chars) + new.sum(), dtype=np.uint32), np.ones(len(chars) + new.sum(), dtype=bool)
        grown[place] = chars
        grown[place[new] - 1] = pick(1, row[new], at[new])
        kept[place[np.cumsum(size) - 1]] = False
        size = size + np.bincount(row[new], minlength=len(size)) - 1
        grown = grown[kept]

        row, at = _numbered(size)
        stays = ~hit(2, row, at)
        grown, size = grown[stays], np.bincount(row[stays], minlength=len(size))

        row, at = _numbered(size)
        other = hit(3, row, at)
        grown[other] = pick(4, row[other], at[other])
        whole, ends = grown.tobytes().decode("utf-32-le"), np.cumsum(size).tolist()
        out = np.full(len(texts), None, dtype=object)
        out[known] = [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
        return pd.Series(out, dtype=object)

    steps = ("insert", "insert letter", "delete", "substitute", "substitute letter")
    return mutated(F.col(text) if isinstance(text, str) else text, *[F.xxhash64(F.lit(seed), *key, F.lit(step)) for step in steps])


def crop_text(text: str | Column, start: Column, end: Column) -> Column:
    first = (start * F.length(text)).cast("int")
    return F.substr(F.col(text) if isinstance(text, str) else text, first + 1, (end * F.length(text)).cast("int") - first)


def crop_sequence(values: str | Column, start: Column, end: Column) -> Column:
    """Part of an array between two fractions, stretched back to the old length (linear, cell centres)."""
    values = F.col(values) if isinstance(values, str) else values
    size = F.size(values)
    first, last = (start * size).cast("int"), (end * size).cast("int")
    part_size = last - first

    def at(t: Column) -> Column:
        place = F.greatest(F.lit(0.0), F.least((t + 0.5) * part_size / size - 0.5, part_size - 1.0))
        low = F.floor(place).cast("int")
        high = F.least(low + 1, part_size - 1)
        a, b = F.get(values, first + low), F.get(values, first + high)
        return a + (b - a) * (place - low)

    return F.when(part_size > 0, F.transform(F.sequence(F.lit(0), size - 1), at))


def maybe_reverse(values: str | Column, key: Sequence[str | Column], seed: int) -> Column:
    values = F.col(values) if isinstance(values, str) else values
    return F.when(uniform(seed, *key) > 0.5, F.reverse(values)).otherwise(values)


def add_distractors(points: DataFrame, lines: DataFrame, by: Sequence[str], ratio: float, seed: int, n: int = 101) -> DataFrame:
    """Extra lines that blend two lines of the same group: rows ``(by, line_id, k, x, y, width)``.

    ``lines`` has ``(by, line_id, width)``. A group of ``m`` lines gets ``int(m * ratio)`` blends; groups of one
    line get none. The blend weight lies in [0.25, 0.75]; the width is the mean of the known widths.
    """
    by = list(by)
    ranked = shuffle(lines.select(*by, "line_id", "width"), by, ["line_id"], seed)
    sizes = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_m")).where("_m >= 2")
    chosen = ranked.join(sizes, by).where(F.col("rank") < F.floor(F.col("_m") * ratio))
    step = 1 + F.floor(uniform(seed + 1, "line_id") * (F.col("_m") - 1))
    first = chosen.withColumn("_mate", F.pmod(F.col("rank") + step, F.col("_m")))
    mates = ranked.select(*by, F.col("rank").alias("_mate"), F.col("line_id").alias("mate_id"), F.col("width").alias("_w2"))
    known = F.filter(F.array("width", "_w2"), lambda w: w.isNotNull())
    width = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, w: s + w) / F.size(known))
    plan = first.join(mates, [*by, "_mate"]).select(
        *by, "line_id", "mate_id", width.alias("width"), (0.25 + 0.5 * uniform(seed + 2, "line_id", "mate_id")).alias("_alpha"),
    )
    shapes = line_arrays(points, n)
    side = lambda s, key: shapes.select(F.col("line_id").alias(key), *[F.col(c).alias(f"{s}_{c}") for c in ("xs", "ys", "dense")])
    rows = plan.join(side("a", "line_id"), "line_id").join(side("b", "mate_id"), "mate_id")
    made = blended(rows, [*by, F.concat(F.lit("distractor-"), "line_id").alias("line_id"), "width"], F.col("_alpha"), n)
    return made.select(*by, "line_id", "k", "x", "y", "width")


def assign_tiles(boxes: DataFrame, height: int, width: int, layers: int, overlap: float) -> DataFrame:
    """Each box with the tiles it overlaps: layer ``i`` has ``2^i`` tiles per side, numbered column by column.

    Tiles of a layer overlap by a share of the short side, so they stand at a fixed step and the first and last tile that
    a box meets follow from its sides.
    """
    rows = boxes.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers)))).withColumn("_n", F.pow(F.lit(2), "layer").cast("int"))
    rows = rows.withColumn("_both", F.when(F.col("layer") > 0, F.floor(F.lit(overlap * min(height, width) * 2) / F.col("_n"))).otherwise(0))
    for axis, side in (("x", width), ("y", height)):
        size = F.ceil((F.col("_both") * (F.col("_n") - 1) + side) / F.col("_n"))
        step = size - F.col("_both")
        first = F.greatest(F.floor((F.col(f"{axis}0") - size) / step) + 1, F.lit(0))
        last = F.least(F.ceil(F.col(f"{axis}1") / step) - 1, F.col("_n") - 1)
        inside = (F.col(f"{axis}0") < side) & (first <= last)
        rows = rows.where(inside).withColumn(f"_t{axis}", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return rows.withColumn("tile", F.col("_tx") * F.col("_n") + F.col("_ty")).drop("_n", "_both", "_tx", "_ty")


def point_grid(n: int) -> Column:
    """Array of ``n`` x ``n`` points at the cell centres of the unit square."""
    at = [(2 * k + 1) / (2 * n) for k in range(n)]
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for y in at for x in at])


def annotations(points: DataFrame, lines: DataFrame, default_width: float) -> DataFrame:
    """Box annotation per line: extent widened by half the width, area, category and ring.

    ``lines`` has ``(line_id, type, width)``. A width of 0 counts as missing. Category 1 is text, 0 is other.
    """
    box = points.groupBy("line_id").agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.max("x").alias("_x1"), F.max("y").alias("_y1"))
    half = F.coalesce(F.nullif(F.col("width"), F.lit(0.0)), F.lit(float(default_width))) / 2
    rows = box.join(lines, "line_id").select(
        "line_id", F.contains("type", F.lit("text")).cast("int").alias("category"),
        (F.col("_x0") - half).alias("x0"), (F.col("_y0") - half).alias("y0"), (F.col("_x1") + half).alias("x1"), (F.col("_y1") + half).alias("y1"),
    )
    ring = F.array("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1")
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return rows.select("line_id", "category", "x0", "y0", w.alias("w"), h.alias("h"), (w * h).alias("area"), ring.alias("ring"))
