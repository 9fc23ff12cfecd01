"""Words on a page: neighbour pairs, line bounds, text, character places."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from pagemill.operators.folds import pair_optimal, placed, together
from pagemill.operators.graphs import least_connected
from pagemill.operators.ordered import neighbours, running_max, scan, with_positions
from pagemill.session import staged

OVERLAP = 0.9
GAP = 1.2
INTS = ArrayType(IntegerType())


CUT_BYTES = 1 << 22  # of texts that are cut together


def _cut(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie one after another in ``data`` (UTF-8), cut at ``ends``: how many each has, their numbers, starts and lengths."""
    whole = data[ends[0] : ends[-1]]
    at = ends - ends[0]
    blank = np.append(whole == 32, True)
    edge = np.zeros(len(blank), dtype=bool)
    edge[at] = True  # a text begins, or the last one is over
    first = np.flatnonzero(~blank & (edge | np.append(True, blank[:-1])))
    last = np.flatnonzero(~blank[:-1] & (edge[1:] | blank[1:])) + 1
    blanks = np.append(0, np.cumsum(blank[:-1], dtype=np.int32))
    signs = (whole & 0xC0) != 0x80
    places = np.arange(len(blank), dtype=np.int32) if signs.all() else np.append(np.int32(0), np.cumsum(signs, dtype=np.int32))
    upto = np.searchsorted(first, at)
    counts = np.diff(upto)
    start = np.repeat(at[:-1], counts)
    return counts, blanks[first] - blanks[start], places[first] - places[start], places[last] - places[first]


@F.arrow_udf(StructType().add("word_no", INTS).add("start", INTS).add("length", INTS))
def _cuts(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    found = [_cut(data, ends[part.start : part.stop + 1]) for part in together(np.diff(ends), CUT_BYTES)] if len(texts) else []
    counts, *columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, dtype=np.int32)] * 4
    upto = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    none = texts.is_null()
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(upto, pa.array(c, pa.int32()), mask=none) for c in columns], ["word_no", "start", "length"])


def with_cuts(lines: DataFrame, text: str = "text") -> DataFrame:
    """Add the arrays ``word_no``, ``start`` and ``length`` of the words of each line: pieces between blanks, in characters, empty ones left out.

    Where a word starts follows from its line alone, so no rows move.
    """
    return lines.withColumn("_cuts", _cuts(text)).select("*", "_cuts.*").drop("_cuts")


def line_words(lines: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """One row per word of a line: ``(keep, word_no, start, text)``."""
    zipped = F.arrays_zip("word_no", "start", F.array_remove(F.split(text, " "), "").alias("text"))
    return with_cuts(lines.select(*keep, text), text).select(*keep, F.inline(zipped)).toDF(*keep, "word_no", "start", "text")


def word_pairs(words: DataFrame, by: Sequence[str], word: Sequence[str]) -> DataFrame:
    """Pairs of words that follow each other on one text line.

    A right word starts less than 1.2 mean heights after the left one ends, and their
    vertical extents overlap by at least 0.9. Heights of such a pair differ by at most
    1/0.9, which bounds where a partner can start: right words are put in one cell
    (height class, row, column), left words look in the few cells within reach.
    """
    by = list(by)
    level = lambda h: F.floor(F.log2(h)).cast("int")
    cell_h = F.pow(F.lit(2.0), F.col("_level") + 1)
    cell_w = F.pow(F.lit(2.0), F.col("_level") + 2)
    mid = F.col("top") + F.col("height") / 2
    right = (
        words.withColumn("_level", level(F.col("height")))
        .withColumn("_row", F.floor(mid / cell_h)).withColumn("_col", F.floor(F.col("left") / cell_w))
        .select(*by, "_level", "_row", "_col", *[F.col(w).alias(f"b_{w}") for w in word],
                *[F.col(c).alias(f"b_{c}") for c in ("left", "top", "height")])
    )
    low, high = F.col("height") * OVERLAP, F.col("height") / OVERLAP
    drift = high - F.col("height")
    start = F.col("left") + F.col("width")
    reach = (F.col("height") + high) / 2 * GAP
    left = words.withColumn("_level", F.explode(F.sequence(level(low), level(high))))
    left = left.withColumn("_row", F.explode(F.sequence(F.floor((mid - drift) / cell_h), F.floor((mid + drift) / cell_h))))
    left = left.withColumn("_col", F.explode(F.sequence(F.floor(start / cell_w), F.floor((start + reach) / cell_w))))
    left = left.select(*by, "_level", "_row", "_col", *[F.col(w).alias(f"a_{w}") for w in word],
                       start.alias("a_right"), F.col("top").alias("a_top"), F.col("height").alias("a_height"))
    pairs = left.join(right, [*by, "_level", "_row", "_col"])
    bottom_a, bottom_b = F.col("a_top") + F.col("a_height"), F.col("b_top") + F.col("b_height")
    inter = F.greatest(F.lit(0.0), F.least(bottom_a, bottom_b) - F.greatest("a_top", "b_top"))
    iou = inter / (F.col("a_height") + F.col("b_height") - inter)
    gap = F.col("b_left") - F.col("a_right")
    close = (gap > 0) & (gap < GAP * (F.col("a_height") + F.col("b_height")) / 2)
    return pairs.where(close & (iou >= OVERLAP)).select(*by, *[f"a_{w}" for w in word], *[f"b_{w}" for w in word], gap.alias("gap"))


SIDES = ("left", "top", "width", "height")


def split_apart(lines: DataFrame, by: Sequence[str], line: str, sides: Sequence[str] = ("",), most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Lines whose height range no other line of the group touches, and the others (None: there are none).

    ``lines`` has the boxes of its words as arrays ``left``, ``top``, ``width`` and ``height``, once per prefix in ``sides``. Words of lines that lie
    apart meet words of their own line only. Just one row per line is moved to find out. With ``most``, lines in which more pairs of words
    of both sides meet along the line are among the others.
    """
    by = list(by)
    bottom = lambda s: F.array_max(F.zip_with(f"{s}top", f"{s}height", lambda t, h: t + h))
    ends = [[F.array_min(f"{s}top") for s in sides], [bottom(s) for s in sides]]
    first, last = (f(*c) if len(c) > 1 else c[0] for f, c in zip((F.least, F.greatest), ends, strict=True))
    many = F.lit(False)
    if most is not None:
        could = reduce(Column.__mul__, [F.size(f"{s}top").cast("long") for s in sides]) > most
        # only lines where more pairs could be made are looked into
        many = could & (_pairs_met(*[F.when(could, F.col(f"{s}{c}")) for s in sides for c in ("left", "width")]) > most)
    extents = staged(lines.select(*by, line, first.alias("_y0"), last.alias("_y1"), many.alias("_many")).where("_y0 IS NOT NULL"), "extents")
    rows = neighbours(with_positions(extents, by, ["_y0", line], "_pos"), by, "_pos", nxt=["_y0"])
    rows = scan(rows, by, "_pos", {"_above": running_max(F.col("_y1"), inclusive=False)})
    near = staged(rows.where("_above > _y0 OR next__y0 < _y1 OR _many").select(*by, line), "near")
    if near.isEmpty():
        return lines, None
    return lines.join(near, [*by, line], "left_anti"), lines.join(near, [*by, line], "left_semi")


def _following(left: np.ndarray, top: np.ndarray, width: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words of a line that follow each other (see ``word_pairs``), and the gaps between them."""
    order = np.argsort(left, kind="stable")
    right, bottom = left + width, top + height
    reach = right + (height + height / OVERLAP) / 2 * GAP * (1 + 1e-9)
    first, last = np.searchsorted(left[order], right, "right"), np.searchsorted(left[order], reach, "right")
    n = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(left)), n)
    b = order[np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
    gap = left[b] - right[a]
    inter = np.maximum(0.0, np.minimum(bottom[a], bottom[b]) - np.maximum(top[a], top[b]))
    kept = (gap > 0) & (gap < GAP * (height[a] + height[b]) / 2) & (inter / (height[a] + height[b] - inter) >= OVERLAP)
    return a[kept], b[kept], gap[kept]


def _each_line(*arrays: pd.Series) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    with np.errstate(divide="ignore", invalid="ignore"):
        for word, *sides in zip(*arrays, strict=True):
            yield np.asarray(word, dtype=np.int32), _following(*[np.asarray(s, dtype=float) for s in sides])


@F.pandas_udf(StructType().add("a", INTS).add("b", INTS).add("gap", ArrayType(DoubleType())))
def _line_pairs(word: pd.Series, left: pd.Series, top: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    found = [(no[a], no[b], gap) for no, (a, b, gap) in _each_line(word, left, top, width, height)]
    return pd.DataFrame(found, columns=["a", "b", "gap"])


@F.pandas_udf(INTS)
def _line_runs(word: pd.Series, left: pd.Series, top: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    first, a_ends, b_ends, numbers = 0, [], [], []
    for no, (a, b, _) in _each_line(word, left, top, width, height):
        rank = np.empty(len(no), dtype=np.int64)
        rank[np.argsort(no, kind="stable")] = np.arange(first, first + len(no))
        a_ends.append(rank[a])
        b_ends.append(rank[b])
        numbers.append((no, rank, first))
        first += len(no)
    label = least_connected(np.concatenate(a_ends), np.concatenate(b_ends), first) if numbers else []
    return pd.Series([np.sort(no)[label[rank] - start] for no, rank, start in numbers], dtype=object)


def in_boxes(lines: DataFrame, word: str) -> DataFrame:
    """The words of lines as rows."""
    zipped = F.arrays_zip(word, *SIDES)
    return lines.select(*[c for c in lines.columns if c not in (word, *SIDES)], F.inline(zipped))


PAIRS_IN_A_LINE = 1 << 20  # lines with more pairs of words that meet along the line meet in cells instead
WORDS_TOGETHER, PAIRS_TOGETHER = 1 << 17, 1 << 21  # of neighbouring lines that are done together


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of lists one after another (NaN for nulls), and how many each list has."""
    return lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _starts(line: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in their order, and where in the input they stand. Words mostly come in order already."""
    step, same = np.diff(x), np.diff(line) == 0
    order = np.lexsort((x, line)) if (same & (step < 0)).any() else np.arange(len(x))
    return placed(line, x)[order], order


def _meetings(line_a: np.ndarray, a: np.ndarray, line_b: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where the boxes of the other side begin that start inside a box of their line: ``first`` and ``last`` place in the other side's order,
    for ``a`` (starts at its own start included) and for ``b`` (left out), and both orders. Rows of boxes are ``x0`` and ``x1``.

    One of two boxes that meet starts inside the other, so these are all the pairs that meet along the line, each once.
    """
    a_starts, by_a = _starts(line_a, a[0])
    b_starts, by_b = _starts(line_b, b[0])
    in_a = [np.searchsorted(b_starts, placed(line_a, x)) for x in a]
    in_b = [np.searchsorted(a_starts, placed(line_b, x), side) for x, side in zip(b, ("right", "left"), strict=True)]
    return (*in_a, *in_b, by_a, by_b)


def _stretch(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``at[k]`` and a number from ``first[k]`` up to ``last[k]``, the end left out."""
    n = np.maximum(last - first, 0)
    return np.repeat(at, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)


def _overlapping(line_a: np.ndarray, a: np.ndarray, line_b: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lines, places of the boxes of the same line that share some area, and their IoU, a stretch of whole lines at a time.

    Boxes are columns ``x0, y0, x1, y1`` in the order of their lines.
    """
    known_a, known_b = (np.flatnonzero(~np.isnan(side).any(axis=0)) for side in (a, b))  # a box without a side shares nothing
    line_a, line_b, a, b = line_a[known_a], line_b[known_b], a[:, known_a], b[:, known_b]
    first_a, last_a, first_b, last_b, by_a, by_b = _meetings(line_a, a[::2], line_b, b[::2])
    lines = max(line_a.max(initial=-1), line_b.max(initial=-1)) + 1
    count = lambda line, first, last: np.bincount(line, np.maximum(last - first, 0), minlength=lines)
    sizes = count(line_a, first_a, last_a) + count(line_b, first_b, last_b)
    for part in together(sizes.astype(np.int64), PAIRS_TOGETHER) if lines else []:
        at_a, at_b = (slice(*np.searchsorted(line, (part.start, part.stop))) for line in (line_a, line_b))
        i, k = _stretch(np.arange(at_a.start, at_a.stop), first_a[at_a], last_a[at_a])
        m, n = _stretch(np.arange(at_b.start, at_b.stop), first_b[at_b], last_b[at_b])
        i, j = np.concatenate((i, by_a[n])), np.concatenate((by_b[k], m))
        p, q = a[:, i], b[:, j]
        w, h = np.minimum(p[2], q[2]) - np.maximum(p[0], q[0]), np.minimum(p[3], q[3]) - np.maximum(p[1], q[1])
        inter = np.maximum(0.0, w) * np.maximum(0.0, h)
        union = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - inter
        score = np.where(union > 0, inter / union, 0.0)
        kept = (w > 0) & (h > 0) & (score > 1e-10)
        i, j = i[kept], j[kept]
        yield line_a[i], known_a[i], known_b[j], score[kept]


@F.arrow_udf(LongType())
def _pairs_met(a_left: pa.Array, a_width: pa.Array, b_left: pa.Array, b_width: pa.Array) -> pa.Array:
    """Pairs of words of a line that meet along it."""
    sides = []
    for left, width in ((a_left, a_width), (b_left, b_width)):
        (x, counts), w = _flat(left), _flat(width)[0]
        known = ~np.isnan(x + w)
        sides += [np.repeat(np.arange(len(counts)), counts)[known], np.stack((x, x + w))[:, known]]
    first_a, last_a, first_b, last_b, _, _ = _meetings(*sides)
    count = lambda line, first, last: np.bincount(line, np.maximum(last - first, 0), minlength=len(a_left))
    return pa.array((count(sides[0], first_a, last_a) + count(sides[2], first_b, last_b)).astype(np.int64))


def _partners(line_a: np.ndarray, a: np.ndarray, line_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place of the box of ``b`` that each box of ``a`` is paired with, -1 for none: the largest total IoU of every line."""
    partner = np.full(len(line_a), -1, dtype=np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        for line, i, j, score in _overlapping(line_a, a, line_b, b):
            alone = (np.bincount(i)[i] == 1) & (np.bincount(j)[j] == 1)
            partner[i[alone]] = j[alone]
            if not alone.all():
                left = pd.DataFrame({"line": line, "i": i, "j": j, "score": score})[~alone]
                chosen = pair_optimal(["line"])(left)
                partner[chosen["i"].to_numpy()] = chosen["j"].to_numpy()
    return partner


@F.arrow_udf(INTS)
def _line_partners(
    a_left: pa.Array, a_top: pa.Array, a_width: pa.Array, a_height: pa.Array, b_left: pa.Array, b_top: pa.Array, b_width: pa.Array, b_height: pa.Array,
) -> pa.Array:
    flat = [[_flat(c) for c in side] for side in ((a_left, a_top, a_width, a_height), (b_left, b_top, b_width, b_height))]
    sides = [(side[0][1], *[v for v, _ in side]) for side in flat]
    counts = [side[0] for side in sides]
    ends = [np.append(0, np.cumsum(n)) for n in counts]
    partner = [np.zeros(0, dtype=np.int64)]
    for part in together(counts[0] + counts[1], WORDS_TOGETHER) if len(a_left) else []:
        lines, boxes = [], []
        for (n, *columns), end in zip(sides, ends, strict=True):
            x, y, w, h = (c[end[part.start] : end[part.stop]] for c in columns)
            lines.append(np.repeat(np.arange(part.stop - part.start), n[part]))
            boxes.append(np.stack((x, y, x + w, y + h)))
        found = _partners(lines[0], boxes[0], lines[1], boxes[1])
        starts = (ends[1][part] - ends[1][part.start])[lines[0]]
        partner.append(np.where(found >= 0, found - starts, -1))
    return pa.ListArray.from_arrays(pa.array(ends[0], pa.int32()), pa.array(np.concatenate(partner), pa.int32()))


def line_partners(apart: DataFrame, text: str = "text") -> DataFrame:
    """Words of side ``a`` of lines that lie apart with the words of side ``b`` they overlap, one to one with the largest total IoU.

    Sides are arrays ``a_left`` to ``b_height``, ``a_<text>`` and ``b_<text>``. Rows are the other columns of the line, ``truth_text`` and
    ``found_text`` (null: no partner); no rows move.
    """
    arrays = [f"{s}_{c}" for s in "ab" for c in SIDES]
    kept = [c for c in apart.columns if c not in (*arrays, f"a_{text}", f"b_{text}")]
    empty = F.array().cast("array<double>")
    at = apart.select(*kept, f"a_{text}", F.col(f"b_{text}").alias("_whole"), _line_partners(*[F.coalesce(c, empty) for c in arrays]).alias("_at"))
    pairs = at.select(*kept, "_whole", F.inline(F.arrays_zip(f"a_{text}", "_at"))).toDF(*kept, "_whole", "truth_text", "_at")
    return pairs.select(*kept, "truth_text", F.get("_whole", "_at").alias("found_text"))


def line_word_pairs(lines: DataFrame, by: Sequence[str], line: str, word: str) -> DataFrame:
    """``word_pairs`` of words that come as arrays of their lines (see ``split_apart``); same rows.

    Lines that lie apart are done inside their row; only the words of the others meet in cells.
    """
    apart, rest = split_apart(lines.where(F.size(word) > 0), by, line)
    found = apart.withColumn("_p", _line_pairs(word, *SIDES)).select(*by, line, F.inline(F.arrays_zip("_p.a", "_p.b", "_p.gap"))).toDF(*by, line, "a", "b", "gap")
    pairs = found.select(*by, F.col(line).alias(f"a_{line}"), F.col("a").alias(f"a_{word}"), F.col(line).alias(f"b_{line}"), F.col("b").alias(f"b_{word}"), "gap")
    return pairs if rest is None else pairs.unionByName(word_pairs(in_boxes(rest, word), by, [line, word]))


def line_runs(apart: DataFrame, by: Sequence[str], line: str, word: str) -> DataFrame:
    """Runs of words that follow each other, in lines that lie apart: ``(by, line, word, first)`` with the least word of the run."""
    zipped = F.arrays_zip(word, "_first")
    return apart.withColumn("_first", _line_runs(word, *SIDES)).select(*by, line, F.inline(zipped)).toDF(*by, line, word, "first")


def bounds(words: DataFrame, by: Sequence[str]) -> DataFrame:
    """Union box of the words of a group as mid line and height."""
    box = words.groupBy(*by).agg(
        F.min("left").alias("x0"), F.min("top").alias("y0"),
        F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"),
    )
    return box.select(*by, "x0", "x1", ((F.col("y0") + F.col("y1")) / 2).alias("y"), (F.col("y1") - F.col("y0")).alias("height"))


def words_to_text(words: DataFrame, by: Sequence[str], order: Sequence[str] = ("left",)) -> DataFrame:
    """Text of a line: its words from left to right. The text is one value of the line."""
    sorted_words = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return words.groupBy(*by).agg(F.array_join(F.transform(sorted_words, lambda w: w["text"]), " ").alias("text"))


def lines_to_page(lines: DataFrame, page: str, order: str) -> DataFrame:
    """Text of a page: its lines in order, each ended by a newline."""
    sorted_lines = F.array_sort(F.collect_list(F.struct(order, "text")))
    text = F.array_join(F.transform(sorted_lines, lambda w: F.concat(w["text"], F.lit("\n"))), "")
    return lines.groupBy(page).agg(text.alias("text"))


def char_positions(words: DataFrame, by: Sequence[str]) -> DataFrame:
    """Middle of the cell of every character of a word, as ``(char_no, char, x, y)``."""
    n = F.length("text")
    chars = words.select("*", F.posexplode(F.split("text", "")).alias("char_no", "char")).where("char <> ''")
    x = F.col("left") + F.col("width") * (2 * F.col("char_no") + 1) / (2 * n)
    return chars.select(*by, "word_no", "char_no", "char", x.alias("x"), (F.col("top") + F.col("height") / 2).alias("y"))


def trim_unmatched(words: DataFrame, by: Sequence[str], shortest: int = 3) -> DataFrame:
    """Unmatched lines cut to their first and last character; texts below ``shortest`` characters drop out."""
    half = F.col("width") / (2 * F.length("text"))
    first, last = F.col("left") + half, F.col("left") + F.col("width") - half
    trimmed = words.groupBy(*by).agg(F.min(first).alias("x0"), F.max(last).alias("x1"), F.sum(F.length("text")).alias("chars"))
    return trimmed.where(F.col("chars") >= shortest)


def substring_grams(df: DataFrame, text: str, n: int, keep: Sequence[str], block: int = 64) -> DataFrame:
    """All character n-grams with their position, rows ``(keep, pos, gram)``.

    A long text is cut into short overlapping blocks first: taking a substring counts characters
    from the start, so blocks keep the work linear. Both steps are generated code, without
    lambda functions, and move no rows between tasks.
    """
    starts = F.explode(F.sequence(F.lit(0), F.length(text) - n, F.lit(block))).alias("_start")
    blocks = df.where(F.length(text) >= n).select(*keep, text, starts)
    blocks = blocks.select(*keep, "_start", F.substr(F.col(text), F.col("_start") + 1, F.lit(block + n - 1)).alias("_part"))
    places = blocks.select("*", F.explode(F.sequence(F.lit(0), F.length("_part") - n)).alias("_i"))
    return places.select(*keep, (F.col("_start") + F.col("_i")).alias("pos"), F.substr(F.col("_part"), F.col("_i") + 1, F.lit(n)).alias("gram"))


def gram_windows(df: DataFrame, text: str, n: int, step: int, keep: Sequence[str], block: int = 64) -> DataFrame:
    """Pieces of a text that hold ``step`` n-grams each, with the ``n - step + 1`` characters that all of these have in common.

    Every n-gram of the text lies in one piece, rows ``(keep, window, core)``; ``block`` is a multiple of ``step``.
    """
    starts = F.explode(F.sequence(F.lit(0), F.length(text) - n, F.lit(block))).alias("_start")
    blocks = df.where(F.length(text) >= n).select(*keep, text, starts)
    blocks = blocks.select(*keep, F.substr(F.col(text), F.col("_start") + 1, F.lit(block + n + step - 2)).alias("_part"))
    last = F.least(F.lit(block - step), F.length("_part") - n)
    places = blocks.select(*keep, "_part", F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("_i"))
    core = F.substr(F.col("_part"), F.col("_i") + step, F.lit(n - step + 1)).alias("core")
    return places.select(*keep, F.substr(F.col("_part"), F.col("_i") + 1, F.lit(n + step - 1)).alias("window"), core)
