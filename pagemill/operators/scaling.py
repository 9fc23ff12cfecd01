"""Scaling values by stored or per-group statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standardize(df: DataFrame, stats: DataFrame, channel: str, value: str) -> DataFrame:
    """``(value - mean) / std`` with one row of statistics per channel."""
    joined = df.join(stats.select(channel, "mean", "std"), channel)
    return joined.withColumn(value, (F.col(value) - F.col("mean")) / F.col("std")).drop("mean", "std")


def minmax(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Shift by the minimum, then divide by the maximum of the shifted values; NULL stays."""
    limits = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(F.col(value)).alias("_hi"))
    shifted = F.col(value) - F.col("_lo")
    top = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return df.join(limits, list(by)).withColumn(value, shifted / top).drop("_lo", "_hi")


def normalize_keypoints(df: DataFrame, by: Sequence[str], size: tuple[float, float] | None = None) -> DataFrame:
    """Centre by half the size and divide by half the longer side."""
    if size:
        rows = df.withColumn("_w", F.lit(float(size[0]))).withColumn("_h", F.lit(float(size[1])))
    else:
        sizes = df.groupBy(*by).agg((1 + F.max("x") - F.min("x")).alias("_w"), (1 + F.max("y") - F.min("y")).alias("_h"))
        rows = df.join(sizes, list(by))
    scale = F.greatest("_w", "_h") / 2
    return rows.withColumn("x", (F.col("x") - F.col("_w") / 2) / scale).withColumn("y", (F.col("y") - F.col("_h") / 2) / scale).drop("_w", "_h")
