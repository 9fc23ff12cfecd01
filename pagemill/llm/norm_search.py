"""Operator 13: exact top-k search by integer inner product, over buckets of vectors of like length.

Components become ``floor(64 * x)``. All vectors are range-partitioned by falling length (sum of squares) and cut into runs of ``RUN_ROWS`` rows,
so run r holds no vector longer than those of run r - 1. A query first meets the longest ``SEEDS`` vectors; the k-th score found
there is its threshold. It visits only the runs whose longest vector can reach it: score <= |q| * |v|. Queries are dealt to groups, and
one task gets one group of queries and one run.

Inside a task, a run is cut into buckets of ``BUCKET_ROWS`` rows, longest first. Per bucket and query the local cosine threshold is
t = threshold / (|q| * longest of the bucket). Above 1 the bucket is passed over. Where t is at least ``COORDINATE_FROM``, coordinate pruning
is used: in the query's largest coordinates, a unit vector within the angle must lie in a narrow interval, which a sorted column of the bucket
gives by binary search. Otherwise length pruning: rows shorter than threshold / |q| are left out. What remains is verified by exact products,
and the thresholds rise from bucket to bucket. Bounds have slack for rounding; products are integers, exact in
doubles below 2**53 and in 64-bit integers beyond.

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows without ``vec_id``, nor vectors whose squares sum
to 2**62 or more, whose products do not fit a long; zero and empty vectors take part; a query meets the vectors of its own number of
components; rows that repeat a ``vec_id`` are one candidate, at its largest score, and no candidate of their own id; equal
scores go to the smaller ``vec_id``; with fewer candidates than asked for all are returned; an empty table gives an empty result; columns
besides ``vec_id`` and ``embedding`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import set_up
from pagemill.session import staged

SCALE, EVERY, TOP = 64, 20, 20
RUN_ROWS, GROUP_ROWS, BUCKET_ROWS, SEEDS = 1 << 14, 1 << 14, 1 << 11, 1 << 12
COMPONENTS = 1 << 21  # of a run, a group and the seeds; wide vectors come in shorter ones
LEVELS, WIDTHS = 4096, 8
COORDINATE_FROM, FOCUS = 0.7, 4
SLACK = 1e-9
RESULT = "query_id long, rank int, vec_id long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v, dim, norm``: integer vectors that take part, equal rows once; ``norm`` is the sum of squares."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**25))  # larger ones exceed the sum below
    rows = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(SCALE * c).cast("long")).alias("v"))
    rows = rows.where(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")) < 2.0**62).dropDuplicates(["vec_id", "v"])
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c)
    return rows.select("vec_id", "v", F.size("v").alias("dim"), norm.alias("norm"))


@dataclass
class Block:
    """Vectors of one width, sorted by ``vec_id``."""

    ids: np.ndarray
    x: np.ndarray
    norm: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def at(self, rows: np.ndarray) -> Block:
        return Block(self.ids[rows], self.x[rows], self.norm[rows])

    @property
    def length(self) -> np.ndarray:
        return np.sqrt(self.norm.astype(np.float64))


def block_of(rows: pd.DataFrame) -> Block:
    rows = rows.sort_values("vec_id", kind="stable")
    width = int(rows["dim"].iloc[0]) if len(rows) else 0
    x = np.stack(rows["v"]).astype(np.int64) if len(rows) and width else np.zeros((len(rows), width), dtype=np.int64)
    return Block(rows["vec_id"].to_numpy(), x, rows["norm"].to_numpy().astype(np.int64))


def products(q: Block, v: Block) -> np.ndarray:
    """Exact inner products of all of ``q`` with all of ``v``, as longs; no partial sum exceeds the product of the lengths."""
    if not len(q) or not len(v):
        return np.zeros((len(q), len(v)), dtype=np.int64)
    if float(q.norm.max()) * float(v.norm.max()) < 2.0**104:
        return (q.x.astype(np.float64) @ v.x.astype(np.float64).T).astype(np.int64)
    return q.x @ v.x.T


NONE = np.iinfo(np.int64).min


class Best:
    """Best ``k`` candidates of every query so far, and the score a further one has to reach."""

    def __init__(self, queries: Block, k: int, floor: np.ndarray):
        self.queries, self.k, self.floor = queries, k, floor.copy()
        self.query, self.ids, self.score = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, rows: np.ndarray, v: Block, scores: np.ndarray) -> None:
        """Merge the scores of the queries at ``rows`` with ``v``; ``NONE`` marks pairs that are no candidates."""
        heads = np.flatnonzero(np.append(True, v.ids[1:] != v.ids[:-1]))
        ids = v.ids[heads]
        if len(heads) < len(v):  # rows of one vec_id are one candidate
            scores = np.maximum.reduceat(scores, heads, axis=1)
        scores = np.where(ids[None, :] == self.queries.ids[rows][:, None], NONE, scores)
        cut = np.maximum(self.floor[rows], NONE + 1)
        if len(ids) > self.k:
            cut = np.maximum(cut, np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        over = scores > cut[:, None]
        level = scores == cut[:, None]  # of equal scores only the first k count
        level &= np.cumsum(level, axis=1) <= self.k
        q, c = np.nonzero(over | level)
        self.put(rows[q], ids[c], scores[q, c])

    def put(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = np.concatenate([self.query, query]), np.concatenate([self.ids, ids]), np.concatenate([self.score, score])
        order = np.lexsort((-score, ids, query))
        order = order[np.append(True, (ids[order][1:] != ids[order][:-1]) | (query[order][1:] != query[order][:-1]))] if len(order) else order
        order = order[np.lexsort((ids[order], -score[order], query[order]))]
        first = np.searchsorted(query[order], np.arange(len(self.queries) + 1))
        place = np.arange(len(order)) - first[query[order]]
        order = order[place < self.k]
        self.query, self.ids, self.score = query[order], ids[order], score[order]
        first = np.searchsorted(self.query, np.arange(len(self.queries) + 1))
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.floor[full] = np.maximum(self.floor[full], self.score[first[full] + self.k - 1])

    def table(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.queries.ids[self.query], "vec_id": self.ids, "score": self.score})


def by_coordinates(q: np.ndarray, unit: np.ndarray, order: np.ndarray, ranked: np.ndarray, t: float) -> np.ndarray:
    """Rows of a bucket whose direction may lie within cosine ``t`` of the unit vector ``q``.

    In coordinate f, such a unit vector lies within q_f * t +- sqrt((1 - t^2) * (1 - q_f^2)). ``order`` and ``ranked`` hold the
    bucket's rows and values sorted by every coordinate.
    """
    focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
    spread = np.sqrt(max(0.0, 1 - t * t) * np.maximum(0.0, 1 - q[focus] ** 2)) + SLACK
    low, high = q[focus] * t - spread, q[focus] * t + spread
    # a pole of the cap inside the interval's sphere: the coordinate then goes up to 1
    high = np.where(q[focus] >= t, 1 + SLACK, high)
    low = np.where(q[focus] <= -t, -1 - SLACK, low)
    lo = np.array([np.searchsorted(ranked[:, f], a, side="left") for f, a in zip(focus, low, strict=True)])
    hi = np.array([np.searchsorted(ranked[:, f], b, side="right") for f, b in zip(focus, high, strict=True)])
    best = int(np.argmin(hi - lo))
    rows = np.sort(order[lo[best] : hi[best], focus[best]])
    inside = ((unit[rows][:, focus] >= low) & (unit[rows][:, focus] <= high)).all(axis=1)
    return rows[inside]


def search(queries: Block, run: Block, k: int, floor: np.ndarray, stats: dict[str, int] | None = None) -> Best:
    """Best candidates of every query in one run, none of them below its ``floor``."""
    best = Best(queries, k, floor)
    lengths = queries.length
    falling = np.argsort(-run.norm, kind="stable")
    for lo in range(0, len(run), BUCKET_ROWS):
        v = run.at(np.sort(falling[lo : lo + BUCKET_ROWS]))
        longest = float(v.length.max())
        with np.errstate(divide="ignore", invalid="ignore"):
            t = best.floor / (lengths * longest)  # a zero length makes nan or infinity: handled below
        bound = best.floor > 0
        t = np.where(bound, np.where(lengths * longest > 0, t, np.inf), -1.0)
        live = np.flatnonzero(t <= 1 + SLACK)
        close = live[t[live] >= COORDINATE_FROM]
        wide = live[t[live] < COORDINATE_FROM]
        if len(close):
            unit = v.x / np.maximum(v.length, 1e-300)[:, None]
            order = np.argsort(unit, axis=0, kind="stable")
            ranked = np.take_along_axis(unit, order, axis=0)
            for i in close:
                rows = by_coordinates(queries.x[i] / lengths[i], unit, order, ranked, float(min(t[i], 1.0)) - SLACK)
                if stats is not None:
                    stats["coordinate"] = stats.get("coordinate", 0) + len(rows)
                if len(rows):
                    part = v.at(rows)
                    best.add(np.array([i]), part, products(queries.at(np.array([i])), part))
        for at in range(0, len(wide), 256):
            q = wide[at : at + 256]
            need = np.where(bound[q], best.floor[q] / np.maximum(lengths[q], 1e-300), -1.0).min()
            part = v.at(np.flatnonzero(v.length >= need * (1 - SLACK)))
            if stats is not None:
                stats["length"] = stats.get("length", 0) + len(q) * len(part)
            if len(part):
                best.add(q, part, products(queries.at(q), part))
    return best


def _seeded(seeds: dict[int, Block], k: int):
    """Threshold of every query from the longest vectors of its width."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby("dim"):
                part = part.sort_values("vec_id", kind="stable")
                best = search(block_of(part), seeds[dim], k, np.full(len(part), NONE)) if dim in seeds else None
                # the score that k different ids reach is a threshold; nothing less is
                yield part.assign(floor=NONE if best is None else best.floor)

    return run


def _searched(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        queries = queries.sort_values("vec_id", kind="stable")
        return search(block_of(queries), block_of(rows), k, queries["floor"].to_numpy().astype(np.int64)).table()

    return run


def top_products(vectors: DataFrame, every: int = EVERY, k: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the queries whose ``vec_id`` is divisible by ``every``."""
    spark = set_up(vectors.sparkSession)
    rows = staged(usable(vectors), "vectors")
    widths = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    run_rows = F.greatest(F.lit(1), F.least(F.lit(RUN_ROWS), F.floor(F.lit(COMPONENTS) / F.greatest("dim", F.lit(1)))))
    # runs by falling length: the place of a row among all of its width comes from a range shuffle and the sizes of its parts
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    sorted_rows = rows.repartitionByRange(int(parts), "dim", F.desc("norm"), F.xxhash64("vec_id", "v")).sortWithinPartitions("dim", F.desc("norm"), F.xxhash64("vec_id", "v"))
    numbered = staged(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), "sorted")
    part_of = F.shiftrightunsigned("_id", 33)
    sizes = numbered.groupBy("dim", part_of.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = staged(sizes.select("dim", "part", "first", before.alias("before")), "starts")
    placed = numbered.withColumn("part", part_of).join(starts, ["dim", "part"])
    place = F.col("before") + F.col("_id") - F.col("first")
    placed = staged(placed.select("vec_id", "v", "dim", "norm", place.alias("place"), F.floor(place / run_rows).cast("long").alias("run")), "placed")

    seeds: dict[int, Block] = {}
    for dim in [r["dim"] for r in widths.orderBy(F.desc("n"), "dim").limit(WIDTHS).collect()]:  # other widths do without seeds
        n = min(SEEDS, COMPONENTS // WIDTHS // max(dim, 1))
        if n >= k:
            seeds[dim] = block_of(placed.where((F.col("dim") == dim) & (F.col("place") < n)).drop("place", "run").toPandas())
    asked = rows.where(F.col("vec_id") % every == 0)
    asked = staged(asked.mapInPandas(_seeded(seeds, k), "vec_id long, v array<long>, dim int, norm long, floor long"), "queries")

    tops = placed.groupBy("dim", "run").agg(F.max("norm").alias("top"))
    # longest vectors of at most LEVELS runs per width; a query visits runs up to the last level that can reach its threshold
    step = F.ceil(F.max("run").over(Window.partitionBy("dim")) / LEVELS + F.lit(1e-12)).cast("long")
    levels = tops.withColumn("step", step).where(F.col("run") % F.col("step") == 0)
    levels = levels.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("run", "top"))).alias("levels"), F.max("step").alias("step"))
    last = tops.groupBy("dim").agg(F.max("run").alias("last"))
    per_group = F.greatest(F.lit(1), F.least(F.lit(GROUP_ROWS), F.floor(F.lit(COMPONENTS) / F.greatest("dim", F.lit(1)))))
    groups = asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select("dim", F.ceil(F.col("n") / per_group).alias("groups"))
    plan = staged(levels.join(last, "dim").join(groups, "dim"), "plan")
    reach = F.sqrt(F.col("norm").cast("double")) * (1 + SLACK)
    far = F.size(F.filter("levels", lambda e: (F.col("floor") <= 0) | (reach * F.sqrt(e["top"].cast("double")) >= F.col("floor"))))
    visits = asked.join(plan, "dim").withColumn("upto", F.least(F.col("last"), far * F.col("step") - 1)).where("upto >= 0")
    run, group = F.explode(F.sequence(F.lit(0).cast("long"), "upto")).alias("run"), F.pmod(F.xxhash64("vec_id", "v"), F.col("groups")).alias("group")
    visits = staged(visits.select("vec_id", "v", "dim", "norm", "floor", group, run), "visits")
    shown = placed.drop("place").join(visits.select("dim", "run", F.col("group").alias("met")).distinct(), ["dim", "run"])
    pairs = visits.groupBy("dim", "run", "group").cogroup(shown.groupBy("dim", "run", "met"))
    found = pairs.applyInPandas(_searched(k), "query_id long, vec_id long, score long")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
