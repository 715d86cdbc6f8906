"""Operators on triangle meshes: clean-up, filters, components, normals and smoothing.

A mesh is a pair of tables: vertices (object, vid, x, y, z and maybe colours) and
triangles (object, tid, v0, v1, v2). Operators return such pairs; what they remove is
found by joins on (object, vid), so that meshes of any size are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from pointloom.functions import geometry as G
from pointloom.operators.graph import connected_components
from pointloom.operators.neighbours import near_distance, transfer_colours
from pointloom.operators.statistics import percentiles
from pointloom.operators.transform import concat
from pointloom.plans.lineage import cut
from pointloom.plans.numbering import number_rows
from pointloom.plans.params import Refine

CORNERS = ("v0", "v1", "v2")


class Mesh(NamedTuple):
    vertices: DataFrame
    triangles: DataFrame


def settled(mesh: Mesh) -> Mesh:
    """The mesh written once, so that what reads both of its tables does not make them again."""
    return Mesh(*(cut(t) for t in mesh))


def with_corners(mesh: Mesh, values: Sequence[str] = G.XYZ) -> DataFrame:
    """Triangles with ``values`` of their three vertices, as p0x, p0y, ... : three equi-joins."""
    out = mesh.triangles
    for i, c in enumerate(CORNERS):
        table = mesh.vertices.select(F.col("object").alias("__o"), F.col("vid").alias("__v"), *(F.col(v).alias(f"p{i}{v}") for v in values))
        out = out.join(table, (F.col("object") == F.col("__o")) & (F.col(c) == F.col("__v"))).drop("__o", "__v")
    return out


def _corner(i: int) -> list[Column]:
    return G.columns(G.XYZ, f"p{i}")


def triangle_shape(mesh: Mesh) -> DataFrame:
    """Triangles with their corners, ``max_edge`` and ``area``."""
    t = with_corners(mesh)
    edges = [F.sqrt(G.squared_distance(_corner(a), _corner(b))) for a, b in ((0, 1), (1, 2), (2, 0))]
    return t.withColumn("max_edge", F.greatest(*edges)).withColumn("area", G.triangle_area(_corner(0), _corner(1), _corner(2)))


def triangle_normals(mesh: Mesh) -> DataFrame:
    """Triangles with a unit normal; zero for a triangle without area."""
    t = with_corners(mesh)
    n = G.cross(G.minus(_corner(1), _corner(0)), G.minus(_corner(2), _corner(0)))
    size = G.norm(n)
    unit = [F.when(size > 0, c / size).otherwise(F.lit(0.0)) for c in n]
    return t.select(*mesh.triangles.columns, *(c.alias(k) for k, c in zip(G.NORMAL, unit, strict=True)))


def vertex_normals(mesh: Mesh) -> DataFrame:
    """Vertices with the normalised sum of their triangles' unit normals; zero where there are none."""
    t = triangle_normals(mesh)
    each = t.select("object", F.explode(F.array(*CORNERS)).alias("vid"), *G.NORMAL)
    sums = each.groupBy("object", "vid").agg(*(F.sum(c).alias(c) for c in G.NORMAL))
    size = G.norm(G.columns(G.NORMAL))
    unit = sums.select("object", "vid", *(F.when(size > 0, F.col(c) / size).otherwise(F.lit(0.0)).alias(c) for c in G.NORMAL))
    joined = mesh.vertices.drop(*G.NORMAL).join(unit, ["object", "vid"], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in G.NORMAL})


def remove_degenerate(mesh: Mesh) -> Mesh:
    """Drops triangles that name a vertex twice."""
    return Mesh(mesh.vertices, mesh.triangles.where("v0 <> v1 and v1 <> v2 and v2 <> v0"))


def remove_duplicate_triangles(mesh: Mesh) -> Mesh:
    """Of triangles with the same vertices in the same turning direction the one with the least tid stays."""
    least = F.least(*CORNERS)
    turned = F.when(F.col("v0") == least, F.array("v0", "v1", "v2")).when(F.col("v1") == least, F.array("v1", "v2", "v0")).otherwise(F.array("v2", "v0", "v1"))
    first = mesh.triangles.groupBy("object", turned.alias("turned")).agg(F.min("tid").alias("tid"))
    return Mesh(mesh.vertices, mesh.triangles.join(first, ["object", "tid"], "left_semi"))


def remove_duplicate_vertices(mesh: Mesh) -> Mesh:
    """Vertices at exactly the same place become the one with the least vid; triangles follow."""
    first = mesh.vertices.groupBy("object", *G.XYZ).agg(F.min("vid").alias("to"))
    remap = mesh.vertices.select("object", "vid", *G.XYZ).join(first, ["object", *G.XYZ]).select("object", "vid", "to")
    vertices = mesh.vertices.join(first.select("object", F.col("to").alias("vid")), ["object", "vid"], "left_semi")
    triangles = mesh.triangles
    for c in CORNERS:
        table = remap.select(F.col("object").alias("__o"), F.col("vid").alias("__v"), F.col("to").alias("__to"))
        triangles = triangles.join(table, (F.col("object") == F.col("__o")) & (F.col(c) == F.col("__v")))
        triangles = triangles.withColumn(c, F.col("__to")).drop("__o", "__v", "__to")
    return Mesh(vertices, triangles)


def remove_unreferenced(mesh: Mesh) -> Mesh:
    used = mesh.triangles.select("object", F.explode(F.array(*CORNERS)).alias("vid")).distinct()
    return Mesh(mesh.vertices.join(used, ["object", "vid"], "left_semi"), mesh.triangles)


def _edges(triangles: DataFrame) -> DataFrame:
    pairs = F.array(*(F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    return triangles.select("object", "tid", F.explode(pairs).alias("e")).select("object", "tid", "e.a", "e.b")


def remove_non_manifold(mesh: Mesh) -> Mesh:
    """Removes the smallest triangles at edges with over two, until no edge has over two.

    In each round every such edge gives up its smallest triangle (then the least tid; areas
    that agree to 12 decimals are equal), so the rounds are as many as the triangles to be
    removed at the worst edge. To drop all but two of an edge at once would take more than is
    needed where a triangle is dropped for another of its edges.
    """
    triangles = cut(triangle_shape(mesh).select(*mesh.triangles.columns, F.round("area", 12).alias("area")))
    while True:
        crowded = _edges(triangles).groupBy("object", "a", "b").agg(F.count("*").alias("n")).where("n > 2")
        touching = _edges(triangles).join(crowded, ["object", "a", "b"]).join(triangles.select("object", "tid", "area"), ["object", "tid"])
        worst = touching.groupBy("object", "a", "b").agg(F.min(F.struct("area", "tid")).alias("w")).select("object", F.col("w.tid").alias("tid")).distinct()
        worst = cut(worst)
        if not worst.limit(1).count():
            return Mesh(mesh.vertices, triangles.drop("area"))
        triangles = cut(triangles.join(worst, ["object", "tid"], "left_anti"))


def reindex(mesh: Mesh) -> Mesh:
    """Vertices and triangles numbered 0, 1, ... in each object, in their old order."""
    vertices = cut(number_rows(mesh.vertices, ["object"], ["vid"], "__n"))
    remap = vertices.select(F.col("object").alias("__o"), F.col("vid").alias("__v"), (F.col("__n") - 1).alias("__to"))
    triangles = mesh.triangles
    for c in CORNERS:
        triangles = triangles.join(remap, (F.col("object") == F.col("__o")) & (F.col(c) == F.col("__v")))
        triangles = triangles.withColumn(c, F.col("__to")).drop("__o", "__v", "__to")
    numbered = number_rows(triangles, ["object"], ["tid"], "__n")
    return Mesh(vertices.withColumn("vid", F.col("__n") - 1).drop("__n"), numbered.withColumn("tid", F.col("__n") - 1).drop("__n"))


def clean(mesh: Mesh) -> Mesh:
    """The basic clean-up, in this order: degenerate, duplicate triangles, duplicate vertices, non-manifold edges, unreferenced."""
    for step in (remove_degenerate, remove_duplicate_triangles, remove_duplicate_vertices):
        mesh = step(mesh)
    return remove_unreferenced(remove_non_manifold(settled(mesh)))


def remove_vertices(mesh: Mesh, gone: DataFrame) -> Mesh:
    """Drops the vertices in ``gone`` (object, vid) and the triangles that touch them."""
    vertices = mesh.vertices.join(gone, ["object", "vid"], "left_anti")
    triangles = mesh.triangles
    for c in CORNERS:
        table = gone.select(F.col("object").alias("__o"), F.col("vid").alias("__v"))
        triangles = triangles.join(table, (F.col("object") == F.col("__o")) & (F.col(c) == F.col("__v")), "left_anti")
    return Mesh(vertices, triangles)


def crop_mesh(mesh: Mesh, low: Sequence[float], high: Sequence[float], margin: float = 0.0) -> Mesh:
    """The vertices within a box widened by ``margin``, borders included, and the triangles that have all theirs there."""
    from pointloom.operators.transform import crop

    inside = crop(mesh.vertices, low, high, margin).select("object", "vid")
    return remove_vertices(mesh, cut(mesh.vertices.select("object", "vid").join(inside, ["object", "vid"], "left_anti")))


def remove_far_vertices(mesh: Mesh, source: DataFrame, distance: float) -> Mesh:
    """Drops vertices further than ``distance`` from every source point."""
    far = near_distance(mesh.vertices, source, distance).where("distance is null").select("object", "vid")
    return remove_vertices(mesh, cut(far))


def remove_low_density(mesh: Mesh, share: float) -> Mesh:
    """Drops the vertices whose ``density`` is below the quantile of their object's."""
    edges = percentiles(mesh.vertices, "density", {"__q": share}, ["object"])
    low = mesh.vertices.join(edges, "object").where("density < __q").select("object", "vid")
    return remove_vertices(mesh, low)


def bad_triangles(mesh: Mesh, source: DataFrame, sample: float, edge: float, area: float | None = None, centre_only: bool = False) -> DataFrame:
    """(object, tid) of triangles that are too long, too large or span empty space.

    The centre (and, unless ``centre_only``, the middle of each edge) must lie within
    ``sample`` of a source point.
    """
    t = triangle_shape(mesh)
    third, half = F.lit(3.0), F.lit(2.0)
    spots = [[(a + b + c) / third for a, b, c in zip(_corner(0), _corner(1), _corner(2), strict=True)]]
    if not centre_only:
        spots += [[(a + b) / half for a, b in zip(_corner(i), _corner(j), strict=True)] for i, j in ((0, 1), (1, 2), (2, 0))]
    sampled = t.select("object", "tid", F.explode(F.array(*(F.struct(*(v.alias(c) for v, c in zip(s, G.XYZ, strict=True))) for s in spots))).alias("s"))
    empty = near_distance(sampled.select("object", "tid", "s.*"), source, sample).where("distance is null").select("object", "tid")
    shape = F.col("max_edge") > edge
    if area is not None:
        shape = shape | (F.col("area") > area)
    return t.where(shape).select("object", "tid").unionByName(empty).distinct()


def remove_triangles(mesh: Mesh, gone: DataFrame) -> Mesh:
    """Drops the triangles in ``gone`` (object, tid), then unreferenced vertices."""
    return remove_unreferenced(Mesh(mesh.vertices, mesh.triangles.join(gone, ["object", "tid"], "left_anti")))


def components(mesh: Mesh) -> DataFrame:
    """(object, tid, component): triangles that share edges; a component is named by its least tid."""
    edges = cut(_edges(mesh.triangles))
    first = edges.groupBy("object", "a", "b").agg(F.min("tid").alias("first"))
    links = edges.join(first, ["object", "a", "b"]).select("object", F.col("tid").alias("u"), F.col("first").alias("v"))
    node = lambda c: F.struct("object", F.col(c).alias("tid"))
    got = connected_components(links.select(node("u").alias("u"), node("v").alias("v")), "u", "v")
    return got.select("node.object", "node.tid", F.col("component.tid").alias("component"))


def component_sizes(mesh: Mesh) -> DataFrame:
    return components(mesh).groupBy("object", "component").agg(F.count("*").alias("n"))


def remove_small_components(mesh: Mesh, least: int = 0, only_largest: bool = False) -> Mesh:
    """Drops components of fewer than ``least`` triangles, or all but each object's largest (then least name)."""
    found = cut(components(mesh))
    sizes = found.groupBy("object", "component").agg(F.count("*").alias("n"))
    if only_largest:
        best = sizes.groupBy("object").agg(F.max(F.struct("n", -F.col("component"))).alias("m"))
        keep = best.select("object", (-F.col("m")[best.schema["m"].dataType.names[1]]).alias("component"))
    else:
        keep = sizes.where(F.col("n") >= least).select("object", "component")
    gone = found.join(keep, ["object", "component"], "left_anti").select("object", "tid")
    return remove_triangles(mesh, gone)


def taubin(mesh: Mesh, steps: int, lam: float = 0.5, mu: float = -0.53) -> Mesh:
    """Taubin smoothing: in turn a step of ``lam`` and one of ``mu`` towards the mean of the neighbours, by distance.

    Neighbours weigh the inverse of their distance. The graph is fixed, so it is made
    once; a step is a join of it with the places and an aggregation.
    """
    pairs = _edges(mesh.triangles).select("object", "a", "b").distinct()
    both = cut(pairs.unionByName(pairs.select("object", F.col("b").alias("a"), F.col("a").alias("b"))))
    spots = cut(mesh.vertices.select("object", "vid", *G.XYZ))
    for k in range(2 * steps):
        factor = lam if k % 2 == 0 else mu
        here = spots.select("object", F.col("vid").alias("a"), *(F.col(c).alias(f"a{c}") for c in G.XYZ))
        there = spots.select("object", F.col("vid").alias("b"), *(F.col(c).alias(f"b{c}") for c in G.XYZ))
        met = both.join(here, ["object", "a"]).join(there, ["object", "b"])
        weight = F.lit(1.0) / (F.sqrt(G.squared_distance(G.columns(G.XYZ, "a"), G.columns(G.XYZ, "b"))) + F.lit(1e-12))
        sums = met.groupBy("object", F.col("a").alias("vid")).agg(F.sum(weight).alias("__w"), *(F.sum(weight * F.col(f"b{c}")).alias(f"__s{c}") for c in G.XYZ))
        moved = spots.join(sums, ["object", "vid"], "left")
        spots = moved.select("object", "vid", *(F.coalesce(F.col(c) + F.lit(factor) * (F.col(f"__s{c}") / F.col("__w") - F.col(c)), F.col(c)).alias(c) for c in G.XYZ))
        spots = cut(spots) if k % 2 else spots
    return Mesh(mesh.vertices.drop(*G.XYZ).join(spots, ["object", "vid"]), mesh.triangles)


def combine(meshes: Sequence[Mesh]) -> Mesh:
    """Meshes of different objects as one object 0: vertices are renumbered, repeats, degenerate and unreferenced parts go."""
    vertices = concat(*(m.vertices for m in meshes))
    triangles = concat(*(m.triangles for m in meshes))
    one = cut(number_rows(vertices.withColumn("__all", F.lit(0)), ["__all"], ["object", "vid"], "__n"))
    remap = one.select(F.col("object").alias("__o"), F.col("vid").alias("__v"), (F.col("__n") - 1).alias("__to"))
    for c in CORNERS:
        triangles = triangles.join(remap, (F.col("object") == F.col("__o")) & (F.col(c) == F.col("__v")))
        triangles = triangles.withColumn(c, F.col("__to")).drop("__o", "__v", "__to")
    numbered = number_rows(triangles.withColumn("__all", F.lit(0)), ["__all"], ["object", "tid"], "__n")
    triangles = numbered.withColumn("object", F.lit(0)).withColumn("tid", F.col("__n") - 1).drop("__n", "__all")
    vertices = one.withColumn("object", F.lit(0)).withColumn("vid", F.col("__n") - 1).drop("__n", "__all")
    mesh = Mesh(vertices, triangles)
    for step in (remove_duplicate_vertices, remove_duplicate_triangles, remove_degenerate, remove_unreferenced):
        mesh = step(mesh)
    return mesh


def refine(mesh: Mesh, points: DataFrame, p: Refine, decimate=None) -> Mesh:
    """Cleans one object's mesh against its source points, smooths it and colours it.

    ``decimate`` (mesh, triangles) -> mesh is applied where it is given. An object that
    a stage empties has no rows in the result.
    """
    from pointloom.operators.transform import crop

    mesh = settled(clean(settled(mesh)))
    low_high = mesh.vertices.agg(*(f(c) for f in (F.min, F.max) for c in G.XYZ)).first()
    if low_high[0] is None:
        return mesh
    source = cut(crop(points, low_high[:3], low_high[3:], p.crop_margin))
    mesh = settled(remove_far_vertices(mesh, source, p.far))
    mesh = settled(remove_triangles(mesh, cut(bad_triangles(mesh, source, p.sample, p.edge, p.area))))
    mesh = settled(remove_small_components(mesh, p.component))
    mesh = settled(decimate(mesh, p.triangles)) if decimate else mesh
    mesh = settled(taubin(mesh, p.taubin_steps, p.taubin_lambda, p.taubin_mu))
    mesh = settled(reindex(remove_unreferenced(remove_far_vertices(mesh, source, p.final_far))))
    return Mesh(vertex_normals(Mesh(transfer_colours(mesh.vertices, source), mesh.triangles)), mesh.triangles)
