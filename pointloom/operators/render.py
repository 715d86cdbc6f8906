"""Rendering objects from several views as pixel tables, in single precision."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pointloom.functions import geometry as G
from pointloom.operators.transform import normalise

#: Views by name, yaw and pitch in degrees (fixed values).
VIEWS = (
    ("front", 0, 0),
    ("back", 180, 0),
    ("left", 90, 0),
    ("right", -90, 0),
    ("top", 0, 90),
    ("diag_1", 45, 25),
    ("diag_2", 135, 25),
    ("diag_3", -45, 25),
)
IMAGE_SIZE, POINT_RADIUS = 224, 2
GREY, WHITE = 140, 255


def rotate_views(points: DataFrame, views: Sequence[tuple[str, float, float]] = VIEWS) -> DataFrame:
    """Every point in every view: turned about y by the yaw, then about x by the pitch; adds ``view``."""

    def rows(yaw: float, pitch: float) -> list:
        a, b = math.radians(yaw), math.radians(pitch)
        return [math.cos(a), math.sin(a), math.cos(b), math.sin(b)]

    names = ("cy", "sy", "cp", "sp")
    table = F.array(*(F.struct(F.lit(v).alias("view"), *(F.lit(x).alias(n) for x, n in zip(rows(y, p), names, strict=True))) for v, y, p in views))
    out = points.withColumn("__v", F.explode(table))
    x = F.col("__v.cy") * F.col("x") + F.col("__v.sy") * F.col("z")
    z = F.col("__v.cy") * F.col("z") - F.col("__v.sy") * F.col("x")
    out = out.withColumns({"x": x, "z": z})
    y2 = F.col("__v.cp") * F.col("y") - F.col("__v.sp") * F.col("z")
    z2 = F.col("__v.sp") * F.col("y") + F.col("__v.cp") * F.col("z")
    return out.withColumns({"y": y2, "z": z2}).withColumn("view", F.col("__v.view")).drop("__v")


def disc(radius: int) -> list[tuple[int, int]]:
    """Offsets of the pixels of a filled circle."""
    span = range(-radius, radius + 1)
    return [(dx, dy) for dx in span for dy in span if dx * dx + dy * dy <= radius * radius + radius * 0.5]


def to_pixels(points: DataFrame, size: int = IMAGE_SIZE) -> DataFrame:
    """Adds px, py of normalised points: cut off, not rounded, and kept on the image; y points up."""
    last = F.lit(float(size - 1))
    at = {"px": (F.col("x") + 1.0) * 0.5 * last, "py": (1.0 - (F.col("y") + 1.0) * 0.5) * last}
    return points.withColumns({k: F.least(F.greatest(v.cast("int"), F.lit(0)), F.lit(size - 1)) for k, v in at.items()})


def rasterise(points: DataFrame, by: Sequence[str] = ("object", "view"), size: int = IMAGE_SIZE, radius: int = POINT_RADIUS, key: str = "point_id") -> DataFrame:
    """The covered pixels of each image: by, px, py, r, g, b; the frontmost (greatest z, then greatest key) point wins.

    Colours are 0 to 255; a missing one is grey. Pixels not in the result are white.
    One aggregation by pixel, combined before the shuffle.
    """
    placed = to_pixels(normalise(points, by), size)
    spots = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in disc(radius)))
    drawn = placed.withColumn("__o", F.explode(spots)).withColumns({"px": F.col("px") + F.col("__o.dx"), "py": F.col("py") + F.col("__o.dy")})
    drawn = drawn.where(F.col("px").between(0, size - 1) & F.col("py").between(0, size - 1))
    front = F.max(F.struct("z", key, *(F.coalesce(F.col(c), F.lit(GREY)).cast("int").alias(c) for c in G.RGB))).alias("__f")
    return drawn.groupBy(*by, "px", "py").agg(front).select(*by, "px", "py", *(F.col(f"__f.{c}").alias(c) for c in G.RGB))


def images(pixels: DataFrame, by: Sequence[str] = ("object", "view"), size: int = IMAGE_SIZE) -> DataFrame:
    """(by, png): each image as a PNG file; an image has a fixed number of pixels, which one task holds."""
    packed = pixels.groupBy(*by).agg(F.collect_list(F.struct("px", "py", *G.RGB)).alias("pixels"))

    @F.pandas_udf("binary")
    def png(batch):
        import numpy as np

        out = []
        for rows in batch:
            image = np.full((size, size, 3), WHITE, dtype=np.uint8)
            for p in rows:
                image[p["py"], p["px"]] = (p["r"], p["g"], p["b"])
            out.append(encode_png(image))
        import pandas as pd

        return pd.Series(out)

    return packed.select(*by, png("pixels").alias("png"))


def encode_png(image) -> bytes:
    """An RGB array of bytes as a PNG file."""
    import struct
    import zlib

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width, _ = image.shape
    lines = b"".join(b"\x00" + image[i].tobytes() for i in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
