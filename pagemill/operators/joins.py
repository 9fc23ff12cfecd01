"""Joins between asset tables. The physical join is left to Spark, which checks sizes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_assets(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of all tables with the same key."""
    return reduce(lambda a, b: a.join(b, key), tables)


def attach_template(rows: DataFrame, templates: DataFrame, key: str) -> DataFrame:
    """Many rows share one template. Spark broadcasts the templates only below its size limit."""
    return rows.join(templates, key)


def keep_existing(matches: DataFrame, left: DataFrame, right: DataFrame, by: Sequence[str], i: str = "i", j: str = "j") -> DataFrame:
    """Matches whose both ends still exist."""
    return matches.join(left.select(*by, i), [*by, i], "left_semi").join(right.select(*by, j), [*by, j], "left_semi")


def unmatched(ids: DataFrame, matches: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """Ids of one side that no match (kept or removed) uses."""
    return ids.select(*by, item).distinct().join(matches.select(*by, item), [*by, item], "left_anti")


def enrich_lines(lines: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach features to lines; lines without one get NULL."""
    return lines.join(features, list(keys), "left")


def leftover(lines: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Features that belong to no line; the strict form of enrichment wants none."""
    return features.join(lines.select(*keys), list(keys), "left_anti")


def require_no_leftover(lines: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Enriched lines; the query fails as soon as a feature has no line."""
    marked = lines.withColumn("_line", F.lit(True)).join(features, list(keys), "full_outer")
    failed = F.raise_error(F.lit("feature without a line"))
    return marked.where(F.when(F.col("_line").isNull(), failed.cast("boolean")).otherwise(F.lit(True))).drop("_line")


def merge_metrics(a: DataFrame, b: DataFrame, key: str, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Full outer merge; columns on both sides get a suffix."""
    shared = (set(a.columns) & set(b.columns)) - {key}

    def renamed(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(*[F.col(c).alias(c + suffix) if c in shared else F.col(c) for c in df.columns])

    return renamed(a, suffixes[0]).join(renamed(b, suffixes[1]), key, "full_outer")


def repeat_rows(df: DataFrame, n: int, name: str = "repeat") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def union_lines(*tables: DataFrame) -> DataFrame:
    """Stack line tables; columns one of them lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


BORDERS = {  # fixed values: the four page sides
    "border_left": ((0.0, 0.0), (0.0, 1.0)),
    "border_top": ((0.0, 0.0), (1.0, 0.0)),
    "border_right": ((1.0, 0.0), (1.0, 1.0)),
    "border_bottom": ((0.0, 1.0), (1.0, 1.0)),
}


def add_borders(lines: DataFrame, key: str = "sample") -> DataFrame:
    """Add the four page sides of every sample as structural lines ``(type, id, line)``."""
    sides = F.array(*[
        F.struct(
            F.lit("vertical_line" if a[0] == b[0] else "horizontal_line").alias("type"), F.lit(name).alias("id"),
            F.array(*[F.struct(F.lit(p[0]).alias("x"), F.lit(p[1]).alias("y")) for p in (a, b)]).alias("line"),
        )
        for name, (a, b) in BORDERS.items()
    ])
    borders = lines.select(key).distinct().select(key, F.inline(sides))
    return lines.unionByName(borders, allowMissingColumns=True)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``."""
    return a.select(*b.columns).subtract(b)


def difference_size(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows each side has more than the other, copies counted."""
    each = lambda df, sign: df.select(*b.columns, F.lit(sign).alias("_s"))
    sums = each(a, 1).unionByName(each(b, -1)).groupBy(*b.columns).agg(F.sum("_s").alias("_s"))
    more = F.coalesce(F.sum(F.greatest("_s", F.lit(0))), F.lit(0))
    less = F.coalesce(F.sum(F.greatest(-F.col("_s"), F.lit(0))), F.lit(0))
    return sums.agg(more.cast("long").alias("left_only"), less.cast("long").alias("right_only"))
