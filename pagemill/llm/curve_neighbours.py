"""Operator 4: approximate nearest neighbours along shifted Hilbert curves.

Every curve has its own random orthogonal projection to a few dimensions, its own shift, and a grid over the range of the sample; a
vector's key is the Hilbert index of its cell. Keys are range-partitioned into blocks at quantiles of the sample. A query looks
through the blocks around its own key on every curve; the windows' best are merged and ranked by exact distances.

Fit: on ``SAMPLE`` rows at most, chosen by hash. The window is the narrowest at which the sample's own queries find the ``target`` share
of their true neighbours, measured against all pairs of the sample. So the effort follows the data: where neighbours are
much closer than other vectors, windows are narrow; on vectors without structure the sample asks for windows that
together cover most of the table, because no ordering can do with less.

A block's rows and visiting queries are salted into tiles of ``TILE`` rows by ``TILE`` queries, so copies of one vector, which share a
block on every curve, spread over tasks.

Cases: vectors that are null, zero, empty, or hold null or non-finite components take no part, nor do vectors whose length is not the most
common one; equal distances go to the smaller ``vec_id``; rows that repeat a ``vec_id`` count as one candidate, at their smallest
distance, and are no candidates of their own id; with fewer candidates than asked for all are returned; rows without ``vec_id`` take no part;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import set_up
from pagemill.llm.hilbert import hilbert_keys
from pagemill.session import staged

CURVES, DIMS, BITS, BLOCKS = 8, 3, 8, 64
SAMPLE, SAMPLE_QUERIES, TARGET = 4096, 256, 0.97
TILE = 4096


@dataclass(frozen=True)
class Curve:
    projection: np.ndarray
    low: np.ndarray
    width: np.ndarray
    edges: np.ndarray

    def keys(self, x: np.ndarray) -> np.ndarray:
        cells = np.clip((x @ self.projection - self.low) / self.width * (1 << BITS), 0, (1 << BITS) - 1)
        return hilbert_keys(cells.astype(np.int64), BITS)

    def blocks(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, self.keys(x), side="right")


@dataclass(frozen=True)
class Index:
    """Curves, and how many blocks a query visits on either side of its own."""

    curves: list[Curve]
    reach: int


def fit(sample: np.ndarray, k: int = 10, target: float = TARGET, seed: int = 4) -> Index:
    draw = np.random.default_rng(seed)
    n, wide = sample.shape
    dims = min(DIMS, wide)
    curves = []
    for _ in range(CURVES):
        projection = np.linalg.qr(draw.normal(size=(wide, wide)))[0][:, :dims]
        y = sample @ projection
        low, high = np.quantile(y, [0.001, 0.999], axis=0)
        width = np.maximum(high - low, 1e-12) * 4 / 3  # a quarter of the grid is left for the shift
        curve = Curve(projection, low - draw.random(dims) * width / 4, width, np.zeros(0, dtype=np.int64))
        edges = np.quantile(curve.keys(sample), np.arange(1, BLOCKS) / BLOCKS, method="higher").astype(np.int64)
        curves.append(Curve(curve.projection, curve.low, curve.width, edges))
    asked = np.arange(n)[:: max(1, n // SAMPLE_QUERIES)]
    square = (sample**2).sum(axis=1)
    far = square[asked][:, None] + square - 2 * sample[asked] @ sample.T
    far[np.arange(len(asked)), asked] = np.inf
    true = np.argsort(far, axis=1)[:, : min(k, max(n - 1, 1))]
    steps = np.full(true.shape, BLOCKS)
    for c in curves:
        block = c.blocks(sample)
        steps = np.minimum(steps, np.abs(block[true] - block[asked][:, None]))
    reach = int(np.quantile(steps, target, method="higher")) if n > 1 else 0
    return Index(curves, reach)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: vectors that take part, in double precision, equal rows once."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = staged(rows.dropDuplicates(["vec_id", "v"]), "vectors")
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def _placed(index: Index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["v"])
                packed = [r.tobytes() for r in x]
                for k, c in enumerate(index.curves):
                    yield pd.DataFrame({"curve": k, "block": c.blocks(x), "vec_id": b["vec_id"], "packed": packed})

    return run


def _nearest(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            rows = rows.sort_values("vec_id", kind="stable")
            ids = rows["vec_id"].to_numpy()
            heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            n = min(k, len(heads))
            x = np.frombuffer(b"".join(rows["packed"]), dtype=np.float64).reshape(len(ids), -1)
            asked = np.frombuffer(b"".join(queries["packed"]), dtype=np.float64).reshape(len(queries), -1)
            square = (x**2).sum(axis=1)
            for lo in range(0, len(asked), 256):
                q = asked[lo : lo + 256]
                rough = square + (q**2).sum(axis=1)[:, None] - 2 * q @ x.T
                rough[queries["vec_id"].to_numpy()[lo : lo + 256][:, None] == ids] = np.inf
                # rows of one vec_id are one candidate
                each = rough if len(heads) == len(ids) else np.minimum.reduceat(rough, heads, axis=1)
                kth = np.partition(each, n - 1, axis=1)[:, n - 1]
                slack = 1e-9 * (square.max() + (q**2).sum(axis=1))  # more than the rough form can err
                for i, query_id in enumerate(queries["vec_id"].tolist()[lo : lo + 256]):
                    near = np.flatnonzero((rough[i] <= kth[i] + slack[i]) & np.isfinite(rough[i]))
                    score = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
                    best = np.lexsort((ids[near], score))
                    _, first = np.unique(ids[near][best], return_index=True)
                    best = best[np.sort(first)[: 2 * k]]
                    out += [(query_id, int(ids[near[j]]), float(score[j])) for j in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def _salted(rows: DataFrame, own: str, other: str, n_own: Column, n_other: Column) -> DataFrame:
    """A row of one side takes one salt of its own and every salt of the other side."""
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce(n_other, F.lit(1)) - 1)
    return rows.withColumn(own, F.pmod(F.xxhash64("vec_id", "curve"), n_own)).withColumn(other, F.explode(copies))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, target: float = TARGET) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the queries whose ``vec_id`` is divisible by ``every``."""
    spark = set_up(vectors.sparkSession)
    rows = usable(vectors)
    each = rows.groupBy("vec_id").agg(F.min("v").alias("v"))  # or rows of one vec_id would be each other's neighbours in the fit
    sample = each.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]  # bounded
    result = "query_id long, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(np.stack(sample), k, target)
    placed = staged(rows.mapInPandas(_placed(index), "curve int, block int, vec_id long, packed binary"), "placed")
    asked = staged(placed.where(F.col("vec_id") % every == 0).dropDuplicates(["curve", "vec_id", "packed"]), "queries")
    visits = asked.withColumn("block", F.explode(F.sequence(F.greatest(F.col("block") - index.reach, F.lit(0)), F.least(F.col("block") + index.reach, F.lit(BLOCKS - 1)))))
    # tiles per block; there are curves x blocks rows of these
    tiles = F.ceil(F.count(F.lit(1)) / TILE)
    key = ["curve", "block"]
    counts = placed.groupBy(*key).agg(tiles.alias("n_rows")).join(visits.groupBy(*key).agg(tiles.alias("n_queries")), key)
    counts = staged(counts, "tiles")
    a = _salted(placed.join(F.broadcast(counts), key), "r", "q", F.col("n_rows"), F.col("n_queries")).drop("n_rows", "n_queries")
    b = _salted(visits.join(F.broadcast(counts), key), "q", "r", F.col("n_queries"), F.col("n_rows")).drop("n_rows", "n_queries")
    tile = [*key, "r", "q"]
    found = a.groupBy(*tile).cogroup(b.groupBy(*tile)).applyInPandas(_nearest(k), result)
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
