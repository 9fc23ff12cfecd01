"""Column expressions: ids, sizes, boxes, points and small encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip_prefix(value: ColumnLike) -> Column:
    """Text after the first ``-``; all of it if there is none."""
    return F.regexp_replace(value, "^[^-]*-", "")


def swap_prefix(value: ColumnLike, old: str, new: str) -> Column:
    return F.replace(_c(value), F.lit(old), F.lit(new))


def fit_area(height: ColumnLike, width: ColumnLike, area: int) -> Column:
    """Whole-number size with about ``area`` pixels and the given aspect ratio."""
    w = F.floor(F.sqrt(F.lit(float(area)) / (_c(height) / _c(width))))
    return F.struct(F.floor(F.lit(float(area)) / w).cast("int").alias("h"), w.cast("int").alias("w"))


def box_corners(left: ColumnLike, top: ColumnLike, width: ColumnLike, height: ColumnLike) -> Column:
    left, top, right, bottom = _c(left), _c(top), _c(left) + _c(width), _c(top) + _c(height)
    return F.array(*[
        F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
        for x, y in ((left, top), (right, top), (right, bottom), (left, bottom))
    ])


def box_xywh(x0: ColumnLike, y0: ColumnLike, x1: ColumnLike, y1: ColumnLike) -> Column:
    return F.struct(_c(x0).alias("x"), _c(y0).alias("y"), (_c(x1) - _c(x0)).alias("w"), (_c(y1) - _c(y0)).alias("h"))


def points_bbox(points: ColumnLike) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def page_normalize(points: ColumnLike, page_width: ColumnLike, page_height: ColumnLike) -> Column:
    return scale_line(points, F.lit(1.0) / _c(page_width), F.lit(1.0) / _c(page_height))


def scale_line(points: ColumnLike, fx: ColumnLike, fy: ColumnLike | None = None) -> Column:
    fx = _c(fx)
    fy = fx if fy is None else _c(fy)
    return F.transform(points, lambda p: F.struct((p["x"] * fx).alias("x"), (p["y"] * fy).alias("y")))


def scale_width(width: ColumnLike, factor: ColumnLike) -> Column:
    return (_c(width) * _c(factor)).cast("int")


def rescale(value: ColumnLike, pad: ColumnLike, scale: ColumnLike, crop: ColumnLike) -> Column:
    """Undo pad, scale and crop; the division result is cut toward zero."""
    return ((_c(value) - _c(pad)) / _c(scale)).cast("int") + _c(crop)


def near_crop_edge(box: Sequence[ColumnLike], crop: Sequence[ColumnLike], page: Sequence[ColumnLike], tolerance: float = 20.0) -> Column:
    """True if a side lies near its crop side but not near its page side."""
    result = F.lit(False)
    for b, c, p in zip(box, crop, page, strict=True):
        near_crop = F.abs(_c(b) - _c(c)) <= tolerance
        near_page = F.abs(_c(b) - _c(p)) <= tolerance
        result = result | (near_crop & ~near_page)
    return result


def is_horizontal(points: ColumnLike) -> Column:
    box = points_bbox(points)
    return (box["x1"] - box["x0"]) > (box["y1"] - box["y0"])


def is_border(points: ColumnLike, margin: float, width: ColumnLike | float = 1.0, height: ColumnLike | float = 1.0) -> Column:
    """Every point lies within ``margin`` (a share of the page) of one and the same side."""
    w = F.lit(width) if isinstance(width, float) else _c(width)
    h = F.lit(height) if isinstance(height, float) else _c(height)
    near = [
        lambda p: p["x"] <= w * margin,
        lambda p: p["x"] >= w * (1.0 - margin),
        lambda p: p["y"] <= h * margin,
        lambda p: p["y"] >= h * (1.0 - margin),
    ]
    return F.greatest(*[F.forall(points, side) for side in near])


def canonical_line(points: ColumnLike, digits: int = 4) -> Column:
    """Left-to-right point order, rounded coordinates."""
    points = _c(points)
    flipped = F.when(F.element_at(points, 1)["x"] > F.element_at(points, -1)["x"], F.reverse(points)).otherwise(points)
    return F.transform(flipped, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))


def has_gap(points: ColumnLike) -> Column:
    """Some coordinate is NULL or NaN."""
    return F.exists(points, lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]))


def clip_line(points: ColumnLike, width: float = 1.0, height: float = 1.0) -> Column:
    def clip(v: Column, top: float) -> Column:
        return F.greatest(F.lit(0.0), F.least(v, F.lit(top)))

    return F.transform(points, lambda p: F.struct(clip(p["x"], width).alias("x"), clip(p["y"], height).alias("y")))


def pos_encode(x: ColumnLike, y: ColumnLike, size: int) -> Column:
    """``size`` values: sin/cos pairs of x, then of y, with falling frequency."""
    out = []
    for value in (_c(x), _c(y)):
        for i in range(size // 4):
            angle = value / F.lit(10000.0 ** (4.0 * i / size))
            out += [F.sin(angle), F.cos(angle)]
    return F.array(*out)


def char_index(text: ColumnLike, alphabet: str, length: int | None = None) -> Column:
    """``(pos, index)`` of every character that is in the alphabet; others give no entry."""
    taken = F.substring(_c(text), 1, length) if length else _c(text)
    entries = F.transform(
        F.split(taken, ""),
        lambda c, i: F.struct(i.alias("pos"), (F.position(c, F.lit(alphabet)) - 1).alias("index"), c.alias("char")),
    )
    known = F.filter(entries, lambda e: (e["index"] >= 0) & (F.length(e["char"]) > 0))
    return F.transform(known, lambda e: F.struct(e["pos"].alias("pos"), e["index"].alias("index")))


def project_point(x: ColumnLike, y: ColumnLike, h: Sequence[ColumnLike], clip: bool = True) -> Column:
    """Apply a 3x3 projective matrix (row by row); optionally clip into the unit page."""
    x, y = _c(x), _c(y)
    h = [_c(v) for v in h]
    d = h[6] * x + h[7] * y + h[8]
    px, py = (h[0] * x + h[1] * y + h[2]) / d, (h[3] * x + h[4] * y + h[5]) / d
    if clip:
        px, py = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) for v in (px, py)]
    return F.struct(px.alias("x"), py.alias("y"))


def label_indicators(label: ColumnLike, classes: int, ignore: int = 255) -> list[Column]:
    """One 0/1 column per class; the ignored label counts as class 0."""
    label = F.when(_c(label) == ignore, 0).otherwise(_c(label))
    return [(label == k).cast("int").alias(f"class_{k}") for k in range(classes)]


def box_iou(a: Sequence[ColumnLike], b: Sequence[ColumnLike]) -> Column:
    """Intersection over union of two ``x0, y0, x1, y1`` boxes; 0 where both are empty."""
    a, b = [_c(v) for v in a], [_c(v) for v in b]
    inter = box_intersection(a, b)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def box_intersection(a: Sequence[ColumnLike], b: Sequence[ColumnLike]) -> Column:
    a, b = [_c(v) for v in a], [_c(v) for v in b]
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return w * h


def box_distance(a: Sequence[ColumnLike], b: Sequence[ColumnLike]) -> Column:
    """Shortest distance between two boxes; 0 if they touch."""
    a, b = [_c(v) for v in a], [_c(v) for v in b]
    dx = F.greatest(F.lit(0.0), b[0] - a[2], a[0] - b[2])
    dy = F.greatest(F.lit(0.0), b[1] - a[3], a[1] - b[3])
    return F.sqrt(dx * dx + dy * dy)
