"""Operator 8: repeated byte strings by suffix arrays.

Pieces meet in shards as ``repeats`` describes. A shard is worked through in blocks of bounded size. A block gets a suffix array by
Larsson-Sadakane refinement: suffixes start ranked by their first seven bytes, and groups that are still tied are refined by the rank of
the suffix as many bytes on as are settled, which doubles every time. Kasai's rule gives the common prefixes of neighbours,
here for all pieces at once, one position after another. Suffixes with a common prefix of the window's length are one
class. Blocks are merged by binary search of their classes' strings in each other's sorted list.

Cases: null and empty texts have no bytes; texts shorter than a window repeat nothing; repeated rows of one ``doc_id`` do not count
against each other; rows without ``doc_id`` come last; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from pagemill.llm.repeats import Kind, Matcher, Removed, Runs, byte_units, remove_repeats

BLOCK_BYTES = 1 << 20
_START = 7  # symbols in the first key: nine bits each


def suffix_array(data: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all suffixes in order; suffix i ends at ``end[i]``, and ties beyond ``depth`` symbols keep any order."""
    n = len(data)
    at = np.arange(n)
    symbol = np.concatenate([data.astype(np.int64) + 1, np.zeros(_START, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for j in range(_START):
        key = (key << 9) | np.where(at + j < end, symbol[j : n + j], 0)
    order = np.argsort(key, kind="stable")
    rank = _ranks(key[order], order, np.zeros(n, dtype=np.int64))
    settled = _START
    tied = _tied(rank[order])
    while len(tied) and settled < depth:
        here = order[tied]
        on = here + settled
        # a suffix that ends within what is settled stands first in its group
        after = np.where(on < end[here], rank[np.minimum(on, n - 1)] + 1, 0)
        pair = rank[here] * (n + 2) + after
        sort = np.argsort(pair, kind="stable")
        here, pair = here[sort], pair[sort]
        order[tied] = here
        new = np.ones(len(pair), dtype=bool)
        new[1:] = pair[1:] != pair[:-1]
        rank[here] = tied[np.flatnonzero(new)][np.cumsum(new) - 1]
        settled *= 2
        tied = tied[_tied(rank[here])]
    return order


def _ranks(keys: np.ndarray, order: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Rank of a suffix: where its group of equal keys starts."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    out[order] = np.flatnonzero(new)[np.cumsum(new) - 1] if len(keys) else 0
    return out


def _tied(ranks: np.ndarray) -> np.ndarray:
    """Places whose neighbour has the same rank."""
    same = ranks[1:] == ranks[:-1]
    tied = np.zeros(len(ranks), dtype=bool)
    tied[1:] |= same
    tied[:-1] |= same
    return np.flatnonzero(tied)


def common_prefixes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, end: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in ``order``, counted up to ``most``.

    Kasai: going one position on in a piece, the common prefix shrinks by one symbol at most, so only what follows is compared.
    """
    n = len(data)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    out = np.zeros(n, dtype=np.int64)
    have = np.zeros(len(start), dtype=np.int64)
    pieces = np.argsort(-(stop - start), kind="stable")
    lengths = (stop - start)[pieces]
    for t in range(int(lengths[0]) if len(lengths) else 0):
        alive = pieces[: np.searchsorted(-lengths, -t, side="left")]
        i = start[alive] + t
        p = place[i]
        j = order[np.maximum(p - 1, 0)]
        h = np.maximum(have[alive] - 1, 0)
        room = np.minimum(np.minimum(end[i] - i, end[j] - j), most)
        h = np.where(p > 0, np.minimum(h, room), 0)
        go = np.flatnonzero((p > 0) & (h < room))
        while len(go):
            go = go[data[i[go] + h[go]] == data[j[go] + h[go]]]
            h[go] += 1
            go = go[h[go] < room[go]]
        have[alive] = h
        out[p] = h
    return out


def _classes(pieces: list[bytes], docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings of the window's length in a block: sorted distinct strings, their smallest document, and (piece, window, class)."""
    size = np.array([len(p) for p in pieces], dtype=np.int64)
    stop = np.cumsum(size)
    start = stop - size
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    piece = np.repeat(np.arange(len(pieces)), size)
    end = stop[piece]
    order = suffix_array(data, end, int(size.max()))  # Kasai's rule needs the whole order; equal suffixes stand by position
    prefix = common_prefixes(data, start, stop, end, order, window)
    whole = end[order] - order >= window
    # shorter suffixes cannot stand between equal windows, as each would come before or after all of them
    at, new = order[whole], prefix[whole] < window
    new[:1] = True
    kind = np.cumsum(new) - 1
    first = np.minimum.reduceat(docs[piece[at]], np.flatnonzero(new))
    heads = at[new]
    strings = np.ascontiguousarray(data[heads[:, None] + np.arange(window)]).view(f"V{window}").ravel()
    return _sortable(strings, window), first, piece[at], at - start[piece[at]], kind


def _sortable(strings: np.ndarray, window: int) -> np.ndarray:
    """Byte strings of one length, as numpy compares them: trailing zero bytes do not matter at equal length."""
    return strings.view(f"S{window}")


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merge two sorted lists of strings with their smallest documents, by binary search of one in the other."""
    (x, dx), (y, dy) = a, b
    at = np.searchsorted(x, y)
    found = np.zeros(len(y), dtype=bool)
    found[at < len(x)] = x[at[at < len(x)]] == y[at < len(x)]
    dx = dx.copy()
    np.minimum.at(dx, at[found], dy[found])
    return np.insert(x, at[~found], y[~found]), np.insert(dx, at[~found], dy[~found])


def matcher(window: int) -> Matcher:
    def match(pieces: list[bytes], docs: np.ndarray, anchors: np.ndarray | None = None) -> list[Runs]:  # blocks are merged whatever the anchors
        cuts, held = [0], 0
        for i, p in enumerate(pieces):
            held += len(p)
            if held >= BLOCK_BYTES:
                cuts.append(i + 1)
                held = 0
        if cuts[-1] < len(pieces):
            cuts.append(len(pieces))
        blocks = [(lo, _classes(pieces[lo:hi], docs[lo:hi], window)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        known = blocks[0][1][0], blocks[0][1][1]
        for _, b in blocks[1:]:
            known = merged(known, (b[0], b[1]))
        out: list[Runs] = []
        for _, (strings, _, piece, at, kind) in blocks:
            first = known[1][np.searchsorted(known[0], strings)][kind]
            order = np.lexsort((at, piece))
            piece, at, first = piece[order], at[order], first[order]
            new = np.ones(len(piece), dtype=bool)
            new[1:] = (piece[1:] != piece[:-1]) | (first[1:] != first[:-1])
            heads = np.flatnonzero(new)
            ends = np.append(heads[1:], len(piece)) - 1
            runs: list[Runs] = [[] for _ in range(piece[-1] + 1)]
            for p, a, b, d in zip(piece[heads].tolist(), at[heads].tolist(), (at[ends] + 1).tolist(), first[heads].tolist(), strict=True):
                runs[p].append((a, b, d))
            out += runs
        return out

    return match


def _report(r: Removed) -> list[tuple]:
    out = []
    for a, b in zip(r.units.first[:-1].tolist(), r.units.first[1:].tolist(), strict=True):
        gone = r.gone[a:b]
        n = int(gone.sum())
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
        kept = r.units.data[a:b][~gone] if n else r.units.data[a:b]
        out.append((b - a, n, runs, hashlib.sha256(kept.tobytes()).hexdigest()))
    return out


def repeated_bytes(docs: DataFrame, window: int = 50, gram: int = 20) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return remove_repeats(docs, Kind(byte_units, window, gram), matcher(window), _report, schema)


def without_repeated_bytes(docs: DataFrame, window: int = 50, gram: int = 20) -> DataFrame:
    """Per document: ``doc_id, kept, spans``: the bytes that stay (they may cut a character) and the byte spans that went."""

    def report(r: Removed) -> list[tuple]:
        out = []
        for a, b in zip(r.units.first[:-1].tolist(), r.units.first[1:].tolist(), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], r.gone[a:b].astype(np.int8), [0]])))
            out.append((r.units.data[a:b][~r.gone[a:b]].tobytes(), edge.reshape(-1, 2).tolist()))
        return out

    return remove_repeats(docs, Kind(byte_units, window, gram), matcher(window), report, "kept binary, spans array<array<long>>")
