"""What the operators of this subpackage share: session settings, table access, and byte-wise word work in numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = bytes([9, 10, 11, 12, 13, 32])  # fixed values: the word separators of every operator here
MASK = (1 << 64) - 1
ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed values: odd multipliers for mixing
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def set_up(spark: SparkSession) -> SparkSession:
    """Settings for Python stages over whole texts: Arrow batches stay small in bytes, however long a text is."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.pythonUDF.arrow.enabled", "true")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return set_up(spark).read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only the two columns that text operators read, so extra columns and their names do not matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


ROW = "_whole_row"


def whole(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct ``ROW``, so that columns of an operator never meet those of the input, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)


def unpacked(docs: DataFrame, **made: Column) -> list[Column]:
    """The columns of ``docs`` out of ``ROW``, those of ``made`` replaced."""
    return [(made[c] if c in made else F.col(f"{ROW}.`{c}`")).alias(c) for c in docs.columns]


LAST = (1 << 63) - 1  # stands for a missing doc_id in Python stages, where a null would turn ids into floats


def known_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST)))


def null_ids(rows: DataFrame) -> DataFrame:
    """Undo ``known_ids``."""
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")))


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * ODD + np.uint64(seed))


_BASE = 0x5851F42D4C957F2D  # fixed value: odd base of the byte polynomial
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = seeds(256, 7)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept between calls and grown when a text is longer."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, math.ceil(math.log2(n + 1)))
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[:] = both
    return _powers[0], _powers[1]


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the byte polynomial; ``spans`` turns them into hashes of any stretch."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], the same wherever the bytes stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """All words of a list of texts: byte positions in ``data``, and the words [first[i], first[i + 1]) of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return spans(byte_sums(self.data), self.start, self.end)


def words_of(texts: list[str | None], lower: bool = False) -> Words:
    """Words between separators of every text; a null text has none."""
    blobs = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.fromiter((len(b) + 1 for b in blobs), dtype=np.int64, count=len(blobs))
    data = np.frombuffer(b" ".join([*blobs, b""]), dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(_IS_SPACE[data], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    ends_at = np.concatenate([[0], np.cumsum(lengths)])
    return Words(data, start, end, np.searchsorted(start, ends_at))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` neighbouring word hashes (one row shorter by n - 1)."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    weights = seeds(n, 101) | np.uint64(1)
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * weights[k]
    return mix(total)


def slices(texts: list[str | None], size: int = 1 << 20):
    """Index ranges of ``texts`` whose characters add up to about ``size``, to bound memory."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
