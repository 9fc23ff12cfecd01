"""Hilbert keys of many points at once, in numpy."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of integer points (one per row, coordinates below 2 ** bits); dims * bits is at most 63.

    On every level, high bits first, the corner that holds a point is turned into the frame of its sub-cube; its Gray code
    rank is the next digit.
    """
    dims = cells.shape[1]
    corners = np.arange(1 << dims)
    gray = corners ^ (corners >> 1)
    rank = np.argsort(gray)
    entry = np.where(corners == 0, 0, gray[2 * ((np.maximum(corners, 1) - 1) // 2)])
    trailing = lambda w: np.array([(~int(x) & (int(x) + 1)).bit_length() - 1 for x in w])
    ahead = np.where(corners == 0, 0, trailing(np.where(corners % 2 == 1, corners, np.maximum(corners, 1) - 1)) % dims)
    full = (1 << dims) - 1

    def turn(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        by = by % dims
        return ((x << by) | (x >> (dims - by))) & full

    key = np.zeros(len(cells), dtype=np.int64)
    enter, axis = np.zeros((2, len(cells)), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        corner = (((cells >> level) & 1) << np.arange(dims)).sum(axis=1)
        digit = rank[turn(corner ^ enter, dims - (axis + 1) % dims)]
        key = (key << dims) | digit
        enter ^= turn(entry[digit], axis + 1)
        axis = (axis + ahead[digit] + 1) % dims
    return key
