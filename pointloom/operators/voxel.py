"""Voxel grids: down-sampling, cells with mean colours, exposed faces and their mesh."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pointloom.functions import geometry as G
from pointloom.operators.transform import quantise_colours, with_colours
from pointloom.plans.numbering import number_rows
from pointloom.plans.scalars import one_row

CELL = ("ix", "iy", "iz")

#: Faces of a cell (fixed values): direction of the neighbour, then the corners in order.
FACES = (
    ((1, 0, 0), ((1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1))),
    ((-1, 0, 0), ((0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0))),
    ((0, 1, 0), ((0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0))),
    ((0, -1, 0), ((0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1))),
    ((0, 0, 1), ((0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))),
    ((0, 0, -1), ((0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0))),
)
#: A face's two triangles by its corners (fixed values).
TRIANGLES = ((0, 1, 2), (0, 2, 3))


def origins(points: DataFrame, size: float, by: Sequence[str] = ()) -> DataFrame:
    """The grid's origin, half a cell below the least coordinate, of each group of ``by`` (or of all points)."""
    half = F.lit(float(size) * 0.5)
    return points.groupBy(*by).agg(*((F.min(c) - half).alias(f"o{c}") for c in G.XYZ))


def with_cells(points: DataFrame, size: float, by: Sequence[str] = ()) -> DataFrame:
    """Adds the origin and the cell of each point; a group's cells start at its own origin."""
    table = origins(points, size, by)
    if by:
        joined = points.join(table, list(by))
    else:
        joined = points.withColumn("__o", one_row(table)).select("*", "__o.*").drop("__o")
    return joined.withColumns({i: G.cell(F.col(c), F.col(f"o{c}"), size) for i, c in zip(CELL, G.XYZ, strict=True)})


def downsample(points: DataFrame, size: float, by: Sequence[str] = ()) -> DataFrame:
    """One point a cell: mean position and colour, and the number of points. Aggregated before the shuffle."""
    values = [c for c in (*G.XYZ, *G.RGB) if c in points.columns]
    return with_cells(points, size, by).groupBy(*by, *CELL).agg(*(F.avg(c).alias(c) for c in values), F.count("*").alias("n"))


def grid(points: DataFrame, size: float, by: Sequence[str] = ()) -> DataFrame:
    """The occupied cells with their mean colour, their number of points and the grid's origin."""
    first = [F.first(f"o{c}").alias(f"o{c}") for c in G.XYZ]
    coloured = with_colours(with_cells(points, size, by), (0.7, 0.7, 0.7))
    return coloured.groupBy(*by, *CELL).agg(*(F.avg(c).alias(c) for c in G.RGB), F.count("*").alias("n"), *first)


def exposed_faces(voxels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, cell, face): the faces without an occupied neighbour, as an anti join on the neighbour's cell."""
    steps = F.array(*(F.struct(F.lit(i).alias("face"), *(F.lit(d).alias(f"d{c}") for d, c in zip(step, CELL, strict=True))) for i, (step, _) in enumerate(FACES)))
    sides = voxels.select(*by, *CELL, F.explode(steps).alias("s"))
    sides = sides.select(*by, *CELL, "s.face", *((F.col(c) + F.col(f"s.d{c}")).alias(f"n{c}") for c in CELL))
    taken = voxels.select(*by, *(F.col(c).alias(f"n{c}") for c in CELL))
    return sides.join(taken, [*by, *(f"n{c}" for c in CELL)], "left_anti").select(*by, *CELL, "face")


def _corner(face: Column, corner: Column, axis: int) -> Column:
    table = F.array(*(F.array(*(F.lit(c[axis]) for c in corners)) for _, corners in FACES))
    return table[face][corner]


def surface_mesh(points: DataFrame, size: float, levels: int, by: Sequence[str] = ("object",)) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of the exposed faces, in the points' own frame.

    A face has four vertices of its own, numbered from 4 (n - 1) for the n-th face in
    the order of cells, and two triangles of one material. vertices: by, vid, x, y, z;
    triangles: by, tid, v0, v1, v2, material, qr, qg, qb.
    """
    voxels = quantise_colours(grid(points, size, by), levels)
    faces = number_rows(exposed_faces(voxels, by), list(by), [*CELL, "face"], "nth")
    known = faces.join(voxels.select(*by, *CELL, "ox", "oy", "oz", "qr", "qg", "qb", "material"), [*by, *CELL])
    corner = F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("corner")
    corners = known.select(*by, *CELL, "face", "nth", "ox", "oy", "oz", corner)
    at = lambda axis: (F.col(f"o{G.XYZ[axis]}") + F.col(CELL[axis]) * F.lit(float(size))) + _corner(F.col("face"), F.col("corner"), axis) * F.lit(float(size))
    vertices = corners.select(*by, (4 * (F.col("nth") - 1) + F.col("corner")).alias("vid"), *(at(i).alias(c) for i, c in enumerate(G.XYZ)))
    halves = F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(v).alias(f"c{i}") for i, v in enumerate(t))) for k, t in enumerate(TRIANGLES)))
    split = known.select(*by, "nth", "material", "qr", "qg", "qb", F.explode(halves).alias("t"))
    base = 4 * (F.col("nth") - 1)
    triangles = split.select(
        *by, (2 * (F.col("nth") - 1) + F.col("t.k")).alias("tid"), *((base + F.col(f"t.c{i}")).alias(f"v{i}") for i in range(3)), "material", "qr", "qg", "qb"
    )
    return vertices, triangles


def centred(vertices: DataFrame, by: Sequence[str] = ("object",)) -> DataFrame:
    """Vertices moved so that the mean vertex of each object is the origin."""
    means = vertices.groupBy(*by).agg(*(F.avg(c).alias(f"__m{c}") for c in G.XYZ))
    joined = vertices.join(means, list(by))
    return joined.withColumns({c: F.col(c) - F.col(f"__m{c}") for c in G.XYZ}).select(*vertices.columns)


def mesh_counts(points: DataFrame, size: float, levels: int, by: Sequence[str] = ("object",)) -> DataFrame:
    """Points, voxels, vertices, triangles and materials of each object's voxel mesh, without building it."""
    voxels = quantise_colours(grid(points, size, by), levels)
    cells = voxels.groupBy(*by).agg(F.sum("n").alias("points"), F.count("*").alias("voxels"), F.countDistinct("material").alias("materials"))
    faces = exposed_faces(voxels, by).groupBy(*by).agg(F.count("*").alias("__f"))
    joined = cells.join(faces, list(by))
    return joined.select(*by, "points", "voxels", (4 * F.col("__f")).alias("vertices"), (2 * F.col("__f")).alias("triangles"), "materials")
