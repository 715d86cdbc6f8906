"""Axis-aligned boxes of groups of points, predicates on them and their line sets."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pointloom.functions import geometry as G
from pointloom.plans.params import BoxFilter, Split

LOW, HIGH, EXTENT, CENTRE = (tuple(p + c for c in G.XYZ) for p in ("min", "max", "extent", "centre"))

#: Corners of a box by which end of each axis they take, and its edges by corners (fixed values).
CORNERS = ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1), (0, 1, 1), (1, 0, 1), (1, 1, 0))
EDGES = ((0, 1), (1, 7), (7, 2), (2, 0), (3, 6), (6, 4), (4, 5), (5, 3), (0, 3), (1, 6), (7, 4), (2, 5))
RED = (1.0, 0.0, 0.0)


def boxes(points: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """Per group: number of points, bounds, extent, centre, volume and mean. One aggregation, combined before the shuffle."""
    means = [F.avg(c).alias(f"mean{c}") for c in G.XYZ]
    bounds = [f(c).alias(a + c) for c in G.XYZ for f, a in ((F.min, "min"), (F.max, "max"))]
    out = points.groupBy(*by).agg(F.count("*").alias("n"), *bounds, *means)
    out = out.withColumns({f"extent{c}": F.col(f"max{c}") - F.col(f"min{c}") for c in G.XYZ})
    out = out.withColumns({f"centre{c}": (F.col(f"min{c}") + F.col(f"max{c}")) * F.lit(0.5) for c in G.XYZ})
    return out.withColumn("volume", F.col("extentx") * F.col("extenty") * F.col("extentz"))


def expand(table: DataFrame, margin: float) -> DataFrame:
    """Boxes widened by ``margin`` on all sides."""
    out = table.withColumns({f"min{c}": F.col(f"min{c}") - F.lit(float(margin)) for c in G.XYZ} | {f"max{c}": F.col(f"max{c}") + F.lit(float(margin)) for c in G.XYZ})
    return out.withColumns({f"extent{c}": F.col(f"max{c}") - F.col(f"min{c}") for c in G.XYZ})


def good(table: DataFrame, limits: BoxFilter) -> DataFrame:
    """The boxes of enough points that are not debris."""
    shape = G.box_is_good(G.columns(EXTENT), limits.min_size, limits.thin_min, limits.thin_keep_footprint, limits.elong_ratio, limits.elong_remove_footprint)
    return table.where((F.col("n") >= limits.min_points) & shape)


def is_big(limits: Split):
    """Whether a box with its number of points is a cluster that may have to be split."""
    wide = F.greatest(*EXTENT) >= limits.max_extent
    return (F.col("n") >= limits.min_points) & (wide | (F.col("volume") >= limits.min_volume))


def oriented_boxes(points: DataFrame, by: str = "label") -> DataFrame:
    """Boxes along the principal axes of each group: centre, extent and rotation (rows are the axes).

    Moments are aggregated before the shuffle; only their 3 x 3 matrices reach Python.
    """
    pairs = [(a, b) for i, a in enumerate(G.XYZ) for b in G.XYZ[i:]]
    moments = points.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in G.XYZ), *(F.avg(F.col(a) * F.col(b)).alias(a + b) for a, b in pairs))

    @F.pandas_udf("array<array<double>>")
    def axes(n: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series, xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
        import numpy as np

        mean = np.stack([x, y, z], axis=1)
        second = np.stack([np.stack([xx, xy, xz], 1), np.stack([xy, yy, yz], 1), np.stack([xz, yz, zz], 1)], 1)
        _, vectors = np.linalg.eigh(second - mean[:, :, None] * mean[:, None, :])
        return pd.Series([v.T[::-1].tolist() for v in vectors])

    frames = moments.select(by, axes("n", *G.XYZ, *(a + b for a, b in pairs)).alias("rotation"))
    turned = points.select(by, *G.XYZ).join(frames, by)
    along = [sum((F.col("rotation")[i][j] * F.col(c) for j, c in enumerate(G.XYZ)), F.lit(0.0)) for i in range(3)]
    spans = turned.groupBy(by).agg(
        F.first("rotation").alias("rotation"), *(F.min(a).alias(f"lo{i}") for i, a in enumerate(along)), *(F.max(a).alias(f"hi{i}") for i, a in enumerate(along))
    )
    middle = [(F.col(f"lo{i}") + F.col(f"hi{i}")) / 2 for i in range(3)]
    centre = F.array(*(sum((F.col("rotation")[i][j] * middle[i] for i in range(3)), F.lit(0.0)) for j in range(3)))
    return spans.select(by, centre.alias("centre"), F.array(*(F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(3))).alias("extent"), "rotation")


def line_sets(table: DataFrame, seq: str = "seq", colour: Sequence[float] = RED) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of numbered boxes as one line set: box n (from 1) has vertices 8 (n - 1) to 8 n - 1.

    vertices: vid, x, y, z. edges: eid, v0, v1, r, g, b.
    """
    first = (F.col(seq) - 1).cast("long")
    ends = F.array(*(F.struct(F.lit(i).alias("i"), *(F.col(("max" if e else "min") + c).alias(c) for e, c in zip(corner, G.XYZ, strict=True))) for i, corner in enumerate(CORNERS)))
    vertices = table.select(first.alias("b"), F.explode(ends).alias("c")).select((F.col("b") * 8 + F.col("c.i")).alias("vid"), "c.x", "c.y", "c.z")
    lines = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("z")) for i, (a, b) in enumerate(EDGES)))
    edges = table.select(first.alias("b"), F.explode(lines).alias("e"))
    rgb = [F.lit(float(v)).alias(c) for v, c in zip(colour, G.RGB, strict=True)]
    return vertices, edges.select((F.col("b") * 12 + F.col("e.i")).alias("eid"), (F.col("b") * 8 + F.col("e.a")).alias("v0"), (F.col("b") * 8 + F.col("e.z")).alias("v1"), *rgb)
