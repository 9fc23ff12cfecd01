"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import forget, staged


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    pairs = _both_ways(edges)
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return pairs.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. ``edges`` has u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``u, v`` long): the least node that it reaches.

    A round is a table in the shared folder. Rounds end when no edge changes, which shows as equal counts and
    sums of hashes; then every node points at the least of its component.
    """
    rows = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if state == seen or not state[0]:
            break
        seen = state
        last, rows = rows, staged(_small_star(_large_star(rows)), "edges")
        forget(last)
    roots = rows.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return rows.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
