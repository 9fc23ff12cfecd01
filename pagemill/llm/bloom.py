"""Blocked Bloom filters: built by Spark tasks slice by slice, probed with numpy.

A block has 256 bits in eight lanes of 32; a key sets one bit in each lane of one block, so a probe touches one cache line. Several
shards may lie behind each other in one filter, each with blocks of its own. A filter says "no" only to keys that were
not put in; at ``KEYS_PER_BLOCK`` keys a block it says "yes" to about one foreign key in 1,500.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pagemill.llm.common import seeds

LANES = 8
BLOCK_BYTES = LANES * 4
KEYS_PER_BLOCK = 16
SLICE = 1 << 12  # blocks that one group builds, 128 KB
_SALTS = seeds(LANES, 31) | np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)


def blocks_for(keys: int) -> int:
    return max(1, -(-keys // KEYS_PER_BLOCK))


def block_of(hashes: np.ndarray, blocks: np.ndarray | int) -> np.ndarray:
    """Block of each key among ``blocks`` (fewer than 2**31), by its upper bits."""
    return ((hashes >> np.uint64(32)) * np.asarray(blocks).astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def _bit(hashes: np.ndarray, lane: int) -> np.ndarray:
    return np.uint32(1) << (((hashes & _LOW) * _SALTS[lane] & _LOW) >> np.uint64(27)).astype(np.uint32)


def put(table: np.ndarray, block: np.ndarray, hashes: np.ndarray) -> None:
    """Add keys to ``table`` (blocks x lanes of uint32)."""
    for lane in range(LANES):
        np.bitwise_or.at(table[:, lane], block, _bit(hashes, lane))


def probe(table: np.ndarray, block: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the keys that may have been put; later lanes look at what the earlier ones let through."""
    at = np.arange(len(hashes))
    for lane in range(LANES):
        at = at[(table[block[at], lane] & _bit(hashes[at], lane)) != 0]
    return at


def build(keys: DataFrame, first: int, blocks: int) -> np.ndarray:
    """The blocks ``first`` to ``first + blocks - 1`` of a filter over ``keys`` (``block, hash`` long).

    Slices are filled in tasks; what reaches the driver is the filter itself, ``blocks * BLOCK_BYTES`` bytes, which the caller bounds.
    """

    def slices(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            b = b[(b["block"] >= first) & (b["block"] < first + blocks)]
            if len(b):
                yield pd.DataFrame({"slice": (b["block"] - first) // SLICE, "block": b["block"] - first, "hash": b["hash"]})

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        k = int(rows["slice"].iloc[0])
        part = np.zeros((SLICE, LANES), dtype=np.uint32)
        put(part, rows["block"].to_numpy() - k * SLICE, rows["hash"].to_numpy().view(np.uint64))
        return pd.DataFrame({"slice": [k], "bits": [part.tobytes()]})

    out = np.zeros((-(-blocks // SLICE) * SLICE, LANES), dtype=np.uint32)
    dealt = keys.mapInPandas(slices, "slice long, block long, hash long")
    for row in dealt.groupBy("slice").applyInPandas(fill, "slice long, bits binary").toLocalIterator():
        out[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["bits"], dtype=np.uint32).reshape(SLICE, LANES)
    return out
