"""Column expressions for points, boxes and triangles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

XYZ, RGB, NORMAL = ("x", "y", "z"), ("r", "g", "b"), ("nx", "ny", "nz")
Vector = Sequence[Column]


def columns(names: Sequence[str], prefix: str = "") -> list[Column]:
    return [F.col(prefix + n) for n in names]


def minus(a: Vector, b: Vector) -> list[Column]:
    return [p - q for p, q in zip(a, b, strict=True)]


def dot(a: Vector, b: Vector) -> Column:
    """Sum of products from left to right, so that other engines can repeat it bit by bit."""
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def squared_distance(a: Vector, b: Vector) -> Column:
    d = minus(a, b)
    return dot(d, d)


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def rotated(v: Vector, matrix: Sequence[Sequence[float]]) -> list[Column]:
    """``matrix @ v``."""
    return [dot(v, [F.lit(float(m)) for m in row]) for row in matrix]


def transposed(matrix: Sequence[Sequence[float]]) -> list[list[float]]:
    return [list(row) for row in zip(*matrix, strict=True)]


def cell(value: Column, origin: Column, size: float) -> Column:
    """The cell of a grid that every operator uses, so that none disagrees at a cell's edge."""
    return F.floor((value - origin) / F.lit(float(size))).cast("long")


def quantised(channel: Column, levels: int) -> Column:
    """A colour channel in [0, 1] as one of ``levels`` steps; halves go to the even step."""
    return F.rint(F.least(F.greatest(channel, F.lit(0.0)), F.lit(1.0)) * F.lit(float(levels - 1))).cast("int")


def material_name(keys: Vector) -> Column:
    return F.format_string("mat_%d_%d_%d", *keys)


def byte_channel(channel: Column, scale_up: Column) -> Column:
    """A colour as 0 to 255: times 255 if ``scale_up``, clipped and cut off, not rounded."""
    scaled = F.when(scale_up, channel * F.lit(255.0)).otherwise(channel)
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0)).cast("int")


def box_gap(a_min: Vector, a_max: Vector, b_min: Vector, b_max: Vector) -> Column:
    """Squared distance between two axis-aligned boxes; 0 where they touch or overlap."""
    gaps = [F.greatest(F.lit(0.0), bl - ah, al - bh) for al, ah, bl, bh in zip(a_min, a_max, b_min, b_max, strict=True)]
    return dot(gaps, gaps)


def box_is_good(extent: Vector, min_size: float, thin_min: float, thin_keep: float, ratio: float, elong_remove: float) -> Column:
    """Whether a box is neither tiny, nor thin and of small footprint, nor elongated and of small footprint."""
    s = F.array_sort(F.array(*extent))
    least, middle, most = s[0], s[1], s[2]
    footprint = most * middle
    tiny = most < min_size
    thin = (least < thin_min) & (footprint < thin_keep)
    elongated = (most / (least + F.lit(1e-9)) > ratio) & (footprint < elong_remove)
    return ~(tiny | thin | elongated)


def triangle_area(p0: Vector, p1: Vector, p2: Vector) -> Column:
    return norm(cross(minus(p1, p0), minus(p2, p0))) * F.lit(0.5)
