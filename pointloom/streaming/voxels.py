"""Voxel counts of a stream of points, on a grid with a fixed origin."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pointloom.functions import geometry as G
from pointloom.operators.voxel import CELL


def stream_voxels(points: DataFrame, size: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), watermark: tuple[str, str] | None = None) -> DataFrame:
    """Mean position and number of points per cell so far; by time window too if ``watermark`` (column, delay) is given.

    A stream has no least coordinate, so the grid's origin is a parameter. Points that
    come later than the watermark allows are dropped.
    """
    cells = points.withColumns({i: G.cell(F.col(c), F.lit(o), size) for i, c, o in zip(CELL, G.XYZ, origin, strict=True)})
    keys = [F.col(c) for c in CELL]
    if watermark:
        column, delay = watermark
        cells = cells.withWatermark(column, delay)
        keys.append(F.window(column, delay).alias("window"))
    return cells.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in G.XYZ), F.count("*").alias("n"))
