"""Sequential rules over groups: groups that fit a task are folded there, many per task; others go in rounds.

The rules here (greedy choice, greedy pairing, elimination) take one step after another, and a round-based form needs as
many rounds as the longest chain of steps. A group of up to ``FOLD_ROWS`` rows is walked through in one pass instead. Both
forms give the same rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagemill.operators.ordered import joined_back, large_groups, may_exceed
from pagemill.session import staged

FOLD_ROWS = 1 << 17


BUCKET = "_bucket"


def sized(df: DataFrame, by: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Staged rows of the groups that fit a task, and of those that do not."""
    rows = staged(df, name)
    large = large_groups(rows, by, FOLD_ROWS) if may_exceed(rows, by, FOLD_ROWS) else None
    if large is None:
        return rows, rows.where(F.lit(False))
    return joined_back(rows, large, by, "left_anti"), joined_back(rows, large, by, "left_semi")


def in_buckets(df: DataFrame, by: Sequence[str]) -> GroupedData:
    """Rows dealt to tables of whole groups, with their number; a table holds many groups, and about ``FOLD_ROWS`` rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, df.count() // FOLD_ROWS + 1)
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*by), F.lit(buckets))).groupBy(BUCKET)


def folded(df: DataFrame, by: Sequence[str], fold: Callable[[pd.DataFrame], pd.DataFrame], columns: Sequence[str]) -> DataFrame:
    """Apply ``fold`` to tables of whole groups (see ``in_buckets``). Returns ``columns`` of ``df``."""
    schema = StructType([df.schema[c] for c in columns])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return fold(rows.drop(columns=BUCKET))[list(columns)]

    return in_buckets(df, by).applyInPandas(run, schema)


def together(sizes: np.ndarray, most: int) -> list[slice]:
    """Neighbouring rows in parts of about ``most`` in all, a larger row alone."""
    part = np.cumsum(sizes) // most
    cuts = np.append(0, np.flatnonzero(np.diff(part)) + 1)
    return [slice(a, b) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sizes)], strict=True)]


def placed(group: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One number per place, in the order of groups and of ``x`` inside them."""
    place = np.empty(len(x), dtype=np.complex128)
    place.real, place.imag = group, x
    return place


def _codes(*tables: pd.DataFrame) -> list[np.ndarray]:
    """Numbers of the rows of several tables, equal for equal rows."""
    names = [f"c{k}" for k in range(tables[0].shape[1])]
    whole = pd.concat([t.set_axis(names, axis=1) for t in tables], ignore_index=True)
    codes = whole.groupby(names, sort=False, dropna=False).ngroup().to_numpy()
    return np.split(codes, np.cumsum([len(t) for t in tables])[:-1])


def _plain(value):
    """A struct as a tuple, which can be compared and hashed."""
    return tuple(map(_plain, value.values())) if isinstance(value, dict) else tuple(map(_plain, value)) if isinstance(value, tuple) else value


def drop_worse(by: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of ``(by, better, worse)`` the rows of the items that a kept better rival drops."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        better, worse = _codes(rows[[*by, "better"]], rows[[*by, "worse"]])
        n = int(max(better.max(initial=-1), worse.max(initial=-1))) + 1
        waits = np.bincount(worse, minlength=n)
        order = np.argsort(better, kind="stable")
        first = np.searchsorted(better[order], np.arange(n + 1))
        below = worse[order].tolist()
        dropped = np.zeros(n, dtype=bool)
        ready = np.flatnonzero(waits == 0).tolist()
        while ready:  # an item is decided once all its better rivals are
            item = ready.pop()
            for w in below[first[item] : first[item + 1]]:
                dropped[w] |= not dropped[item]
                waits[w] -= 1
                if not waits[w]:
                    ready.append(w)
        return rows[dropped[worse]].drop_duplicates([*by, "worse"])

    return fold


def pair_best(by: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One-to-one pairs of ``(by, i, j, score)`` by falling score, ties by ``(i, j)``."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = ([_plain(v) for v in rows[c].tolist()] for c in ("i", "j"))
        group, score = _codes(rows[by])[0].tolist(), rows["score"].tolist()
        used_left, used_right, kept = set(), set(), np.zeros(len(rows), dtype=bool)
        for k in sorted(range(len(rows)), key=lambda k: (-score[k], i[k], j[k])):
            a, b = (group[k], i[k]), (group[k], j[k])
            if a not in used_left and b not in used_right:
                kept[k] = True
                used_left.add(a)
                used_right.add(b)
        return rows[kept]

    return fold


def pair_optimal(by: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One-to-one pairs of ``(by, i, j, score)`` with the largest total; only scores above 0 pair.

    Items of ``i`` come in one after another. Each looks for the cheapest chain of changes that ends in a free item of ``j`` or in an item of
    ``i`` that stays single instead; gains of ``i`` and prices of ``j`` add up to at least the score of every row and to the score itself
    of every pair, which proves the total to be the largest. A search ends at the first such end, so it stays near its start.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["score"] > 0]
        i, j = ([_plain(v) for v in rows[c].tolist()] for c in ("i", "j"))
        group, score = _codes(rows[by])[0].tolist() if len(rows) else [], rows["score"].tolist()
        left: dict[tuple, int] = {}
        right: dict[tuple, int] = {}
        offers: list[list[tuple[int, float, int]]] = []
        for k in sorted(range(len(rows)), key=lambda k: (group[k], i[k], j[k], -score[k])):
            a, b = left.setdefault((group[k], i[k]), len(left)), right.setdefault((group[k], j[k]), len(right))
            if a == len(offers):
                offers.append([])
            offers[a].append((b, score[k], k))
        gain, price = [0.0] * len(left), [0.0] * len(right)
        taken, owner, chosen = [-1] * len(left), [-1] * len(right), [-1] * len(left)

        def place(start: int) -> None:
            gain[start] = max(0.0, max(w - price[b] for b, w, _ in offers[start]))
            limit, single, free = gain[start], start, -1  # the cheapest end so far: the start itself stays single
            inside, came, front = [(0.0, start)], {}, []

            def look(a: int, far: float) -> None:
                for b, w, k in offers[a]:
                    if b not in came and far + gain[a] + price[b] - w < limit:
                        heapq.heappush(front, (max(far, far + gain[a] + price[b] - w), b, a, k))

            look(start, 0.0)
            while front and front[0][0] < limit:
                far, b, a, k = heapq.heappop(front)
                if b in came:
                    continue
                came[b] = (far, a, k)
                other = owner[b]
                if other < 0:
                    limit, free = far, b
                    break
                inside.append((far, other))
                if far + gain[other] < limit:
                    limit, single = far + gain[other], other
                look(other, far)
            for far, a in inside:
                gain[a] -= max(0.0, limit - far)
            for b, (far, _, _) in came.items():
                price[b] += max(0.0, limit - far)
            b = free
            if b < 0:
                if single == start:
                    return
                b, taken[single], chosen[single] = taken[single], -1, -1
            while True:
                _, a, k = came[b]
                owner[b], chosen[a] = a, k
                taken[a], b = b, taken[a]
                if a == start:
                    return

        for start in range(len(left)):
            place(start)
        return rows.iloc[sorted(k for k in chosen if k >= 0)]

    return fold


def drop_steep(by: list[str], low: float, high: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Points of ``(by, seq, x, y)`` that stay when the one with the greatest gain (ties: the earlier) goes, again and again."""

    def bad(x: list, y: list, a: int, b: int) -> int:
        if a < 0 or b < 0 or x[b] == x[a] or any(v != v or v is None for v in (x[a], x[b], y[a], y[b])):
            return 0
        slope = (y[b] - y[a]) / (x[b] - x[a])
        return int(slope < low or slope > high)

    def gaining(code: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which points have a gain, of lines one after another."""

        def steep(far: int) -> np.ndarray:
            out = np.zeros(len(x), dtype=np.int64)
            dx = x[far:] - x[:-far]
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                slope = (y[far:] - y[:-far]) / dx
            out[far:] = ((slope < low) | (slope > high)) & (dx != 0) & (code[far:] == code[:-far])
            return out

        one, two = steep(1), steep(2)
        return one + np.append(one[1:], 0) - np.append(two[1:], 0) > 0

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return rows
        rows = rows.sort_values("seq", kind="stable")
        code = _codes(rows[by])[0]
        order = np.argsort(code, kind="stable")
        rows, code = rows.iloc[order], code[order]
        whole_x, whole_y = (rows[c].to_numpy(dtype=float) for c in ("x", "y"))
        kept = np.ones(len(rows), dtype=bool)
        # a line where no point has a gain stays as it is
        some = np.unique(code[gaining(code, whole_x, whole_y)])
        for first, last in zip(np.searchsorted(code, some).tolist(), np.searchsorted(code, some, side="right").tolist(), strict=True):
            x, y, n = whole_x[first:last].tolist(), whole_y[first:last].tolist(), last - first
            before, after = list(range(-1, n - 1)), [*range(1, n), -1]
            gain = lambda k: bad(x, y, before[k], k) + bad(x, y, k, after[k]) - bad(x, y, before[k], after[k])  # noqa: B023, E731
            now = [gain(k) for k in range(n)]
            heap = [(-g, k) for k, g in enumerate(now) if g > 0]
            heapq.heapify(heap)
            alive = kept[first:last]
            while heap:
                g, k = heapq.heappop(heap)
                if not alive[k] or now[k] != -g:
                    continue
                alive[k] = False
                a, b = before[k], after[k]
                if a >= 0:
                    after[a] = b
                if b >= 0:
                    before[b] = a
                for m in (a, b):
                    if m >= 0:
                        now[m] = gain(m)
                        if now[m] > 0:
                            heapq.heappush(heap, (-now[m], m))
        return rows[kept]

    return fold


def longest_paths(rows: pd.DataFrame) -> pd.DataFrame:
    """Path rows ``component, step, node, length`` of trees given as ``(component, a, b)``, each edge both ways.

    From the least node to the farthest one, from there to the farthest again; ties go to the lesser node.
    """
    out = []
    for component, edges in rows.groupby("component", sort=False):
        near: dict[int, list[int]] = {}
        for a, b in zip(edges["a"].tolist(), edges["b"].tolist(), strict=True):
            near.setdefault(a, []).append(b)

        def depths(start: int) -> dict[int, int]:
            depth, front = {start: 0}, [start]
            while front:
                front = [b for a in front for b in near[a] if b not in depth and not depth.__setitem__(b, depth[a] + 1)]  # noqa: B023
            return depth

        far = lambda d: min(d, key=lambda k: (-d[k], k))
        one = depths(far(depths(component)))
        other = far(one)
        back, length = depths(other), one[other]
        out += [(component, one[k], k, length) for k in one if one[k] + back[k] == length]
    return pd.DataFrame(out, columns=["component", "step", "node", "length"])


def envelope(x: list[int], f: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """Lower envelope of the parabolas ``(t - x[k]) ** 2 + f[k]``, ``x`` rising: the parabolas on it, and where each follows the one
    before, as a fraction. Parabolas that only touch the envelope stay on it.
    """
    stack: list[int] = []
    starts: list[tuple[int, int]] = []
    for k in range(len(x)):
        while stack:
            p = stack[-1]
            above, below = f[k] + x[k] * x[k] - f[p] - x[p] * x[p], 2 * (x[k] - x[p])
            if len(stack) > 1 and above * starts[-1][1] < starts[-1][0] * below:
                stack.pop()
                starts.pop()
                continue
            starts.append((above, below))
            break
        else:
            starts.append((0, 0))
        stack.append(k)
    return stack, starts


def nearest_in_rows(by: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Values of the missing cells of rows ``(by, x, missing, cy, value)``, where ``(cy, value)`` is the nearest known cell of the column.

    The nearest of all wins, ties go to the least ``cy``, then to the least column. Cells of rows without any known cell get none.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in rows.sort_values("x", kind="stable").groupby(by, sort=False, dropna=False):
            known, missing = row[row["cy"].notna()], row[row["missing"]]
            if not len(known):
                continue
            picked = _along_envelope([int(v) for v in known["x"]], [int(v) for v in known["cy"]], int(row[by[-1]].iloc[0]), [int(v) for v in missing["x"]])
            out.append(missing.assign(value=known["value"].to_numpy()[picked]))
        return pd.concat(out) if out else rows.iloc[:0]

    return fold


PAIRS = 1 << 20  # of cells and columns that are looked at together
SHORT_ROW = 64  # known columns of a row that each of its missing cells is held against
FAR = 1 << 30  # spans below this keep squares within 64 bits


def _nearest_in_columns(column: np.ndarray, y: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For cells sorted by column and ``y`` the nearest known cell of the own column (ties: the least ``y``), -1 where there is none."""
    n = len(y)
    at = np.arange(n)
    up = np.maximum.accumulate(np.where(known, at, -1))
    down = np.minimum.accumulate(np.where(known, at, n)[::-1])[::-1]
    has_up = (up >= 0) & (column[up] == column)
    has_down = (down < n) & (column[np.minimum(down, n - 1)] == column)
    above, below = y - y[up], y[np.minimum(down, n - 1)] - y
    return np.where(has_up & (~has_down | (above <= below)), up, np.where(has_down, down, -1))


def _nearest_in_short_rows(size: np.ndarray, first: np.ndarray, x: np.ndarray, y: np.ndarray, at_x: np.ndarray, at_y: np.ndarray) -> np.ndarray:
    """For missing cells at ``(at_x, at_y)`` the best of the ``size`` columns (at least one) from ``first`` on, which stand at ``x`` with known cells at ``y``."""
    start = np.cumsum(size) - size
    cell = np.repeat(np.arange(len(size)), size)
    option = np.arange(len(cell)) - np.repeat(start - first, size)
    d2, cy = (at_x[cell] - x[option]) ** 2 + (at_y[cell] - y[option]) ** 2, y[option]
    best = d2 == np.minimum.reduceat(d2, start)[cell]
    cy = np.where(best, cy, np.iinfo(np.int64).max)
    best &= cy == np.minimum.reduceat(cy, start)[cell]
    return np.minimum.reduceat(np.where(best, option, len(x)), start)  # columns rise along a row


def nearest_in_grids(by: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Whole grids ``(by, y, x, value, missing)`` with the value of the nearest known cell in missing ones (ties: least ``y``, then ``x``).

    ``missing`` stays set where a grid has no known cell. All grids of a table are done together: nearest known cells of columns first, then
    every missing cell is held against the columns of its row. Rows of many columns are walked along their lower envelope.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return rows
        group = _codes(rows[by])[0]
        y, x = (rows[c].to_numpy(dtype=np.int64) for c in ("y", "x"))
        known = ~rows["missing"].to_numpy(dtype=bool)
        order = np.lexsort((y, x, group))
        column = np.cumsum(np.append(True, (np.diff(group[order]) != 0) | (np.diff(x[order]) != 0)))
        near = np.empty(len(rows), dtype=np.int64)
        found = _nearest_in_columns(column, y[order], known[order])
        near[order] = np.where(found >= 0, order[found], -1)

        order = np.lexsort((x, y, group))
        group, y, x, known, near = group[order], y[order], x[order], known[order], near[order]
        row = np.cumsum(np.append(True, (np.diff(group) != 0) | (np.diff(y) != 0))) - 1
        columns = np.flatnonzero(near >= 0)
        source = near[columns]
        cx, cy = x[columns], rows["y"].to_numpy(dtype=np.int64)[source]
        size = np.bincount(row[columns], minlength=row[-1] + 1)
        first = np.cumsum(size) - size
        holes = np.flatnonzero(~known & (size[row] > 0))
        picked = np.empty(len(holes), dtype=np.int64)
        near_enough = max(int(x.max()) - int(x.min()), int(y.max()) - int(y.min())) < FAR
        short = size[row[holes]] <= SHORT_ROW if near_enough else np.zeros(len(holes), dtype=bool)
        few = np.flatnonzero(short)
        step = PAIRS // SHORT_ROW
        for k in range(0, len(few), step):
            part = holes[few[k : k + step]]
            picked[few[k : k + step]] = _nearest_in_short_rows(size[row[part]], first[row[part]], cx, cy, x[part], y[part])
        many = np.flatnonzero(~short)
        ends = np.flatnonzero(np.append(True, np.diff(row[holes[many]]) != 0)) if len(many) else []
        for part in np.split(many, ends[1:]) if len(many) else []:
            r = row[holes[part[0]]]
            at = slice(first[r], first[r] + size[r])
            picked[part] = first[r] + np.array(_along_envelope(cx[at].tolist(), cy[at].tolist(), int(y[holes[part[0]]]), x[holes[part]].tolist()))
        filled, missing = rows["value"].to_numpy(copy=True), ~known
        filled[order[holes]] = filled[source[picked]]
        missing[holes] = False
        left = np.empty(len(rows), dtype=bool)
        left[order] = missing
        return rows.assign(value=filled, missing=left)

    return fold


def _along_envelope(x: list[int], cy: list[int], y: int, missing: list[int]) -> list[int]:
    """Numbers of the columns nearest to the missing places of a row, both rising; ties go to the least ``cy``, then to the least column."""
    stack, starts = envelope(x, [(y - c) ** 2 for c in cy])
    at, picked = 0, []
    for t in missing:
        while at + 1 < len(stack) and starts[at + 1][0] < t * starts[at + 1][1]:
            at += 1
        end = at
        while end + 1 < len(stack) and starts[end + 1][0] == t * starts[end + 1][1]:
            end += 1  # all of these are equally near
        picked.append(min(stack[at : end + 1], key=lambda k: (cy[k], x[k])))
    return picked
