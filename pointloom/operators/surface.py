"""Per-object mesh algorithms that have no relational form: normals, their orientation and decimation.

Each works on one object at a time, in numpy. Poisson reconstruction needs an outside
solver; ``reconstruct`` takes one as a function.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pointloom.functions import geometry as G
from pointloom.operators.mesh import Mesh, bad_triangles, clean, crop_mesh, remove_far_vertices, remove_low_density, remove_small_components, remove_triangles, settled, taubin, vertex_normals
from pointloom.operators.neighbours import _at_places, over_nearest, transfer_colours
from pointloom.plans.lineage import cut
from pointloom.plans.params import Reconstruct


def estimate_normals(points: DataFrame, radius: float, most: int) -> DataFrame:
    """Adds nx, ny, nz: the least principal axis of the at most ``most`` nearest points within ``radius``.

    Moments of the neighbours are aggregated; only 3 x 3 matrices reach Python. Fewer
    than three neighbours give (0, 0, 1). The sign is not defined: see ``orient_normals``.
    """
    spots = cut(points.select(*(F.col(c).alias(f"r{c}") for c in G.XYZ)).dropna().distinct())
    d = {c: F.col(f"r{c}") - F.col(f"l{c}") for c in G.XYZ}
    pairs = [(a, b) for i, a in enumerate(G.XYZ) for b in G.XYZ[i:]]
    sums = over_nearest(spots, most, radius, *(F.avg(d[c]).alias(c) for c in G.XYZ), *(F.avg(d[a] * d[b]).alias(a + b) for a, b in pairs))

    @F.pandas_udf("struct<nx:double,ny:double,nz:double>")
    def axis(n: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series, xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        mean = np.stack([x, y, z], axis=1)
        second = np.stack([np.stack([xx, xy, xz], 1), np.stack([xy, yy, yz], 1), np.stack([xz, yz, zz], 1)], 1)
        _, vectors = np.linalg.eigh(second - mean[:, :, None] * mean[:, None, :])
        out = vectors[:, :, 0]
        out[n.to_numpy() < 3] = (0.0, 0.0, 1.0)
        return pd.DataFrame(out, columns=list(G.NORMAL))

    table = sums.select("lx", "ly", "lz", axis("n", *G.XYZ, *(a + b for a, b in pairs)).alias("__n")).select("lx", "ly", "lz", "__n.*")
    return _at_places(points.drop(*G.NORMAL), table)


#: Points of a leaf of the tree that the nearest neighbours within an object are searched in.
_LEAF = 64


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for i in range(3):
        step = a[:, i, None] - b[None, :, i]
        out += step * step
    return out


def _near(points: np.ndarray, k: int) -> np.ndarray:
    """The second to the (k + 1)-th nearest of each point by distance, then position: its k neighbours, as the first is itself or a copy.

    Leaves of a tree of boxes meet only leaves that are near enough to hold a neighbour. Of copies only
    the first k + 1 can be among the nearest, and all have the same ones.
    """
    n = len(points)
    _, heads, place = np.unique(points, axis=0, return_index=True, return_inverse=True)
    place = place.ravel()
    order = np.argsort(place, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n) - np.searchsorted(place[order], place[order])
    leaves, stack = [], [np.flatnonzero(rank <= k)]
    while stack:
        own = stack.pop()
        if len(own) <= _LEAF:
            leaves.append(own)
            continue
        axis = int(np.ptp(points[own], axis=0).argmax())
        own = own[np.argpartition(points[own, axis], len(own) // 2)]
        stack += [own[: len(own) // 2], own[len(own) // 2 :]]
    low, high = (np.array([f(points[x], axis=0) for x in leaves]) for f in (np.min, np.max))
    sizes = np.array([len(x) for x in leaves])
    out = np.empty((n, k), dtype=np.int64)
    for at, own in enumerate(leaves):
        asked = own[rank[own] == 0]
        if not len(asked):
            continue
        gap = np.maximum(np.maximum(low - high[at], low[at] - high), 0.0)
        gap = (gap * gap).sum(axis=1)
        first = np.argsort(gap, kind="stable")
        first = first[: int(np.searchsorted(np.cumsum(sizes[first]), k + 1)) + 1]
        d = _squared(points[asked], points[np.concatenate([leaves[x] for x in first])])
        bound = np.partition(d, k, axis=1)[:, k].max() * (1 + 1e-9)
        met = np.sort(np.concatenate([leaves[x] for x in np.flatnonzero(gap <= bound)]))
        d = _squared(points[asked], points[met])
        row, column = np.nonzero(d <= np.partition(d, k, axis=1)[:, k, None])
        by = np.lexsort((column, d[row, column], row))
        row, column = row[by], column[by]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        kept = (nth >= 1) & (nth <= k)
        out[asked] = met[column[kept]].reshape(-1, k)
    return out[heads[place]]


def _orient(points: np.ndarray, normals: np.ndarray, k: int) -> np.ndarray:
    """Walks a minimum spanning tree of the k-nearest graph, from the highest point, flipping against the parent."""
    whole = np.isfinite(points).all(axis=1) & np.isfinite(normals).all(axis=1)
    if not whole.all():  # points without a place or a normal stay as they are
        out = normals.copy()
        out[whole] = _orient(points[whole], normals[whole], k)
        return out
    n = len(points)
    k = min(k, n - 1)
    if k < 3:
        return normals
    near = _near(points, k)
    links: list[list[int]] = [[] for _ in range(n)]
    for i in range(n):
        for j in near[i]:
            links[i].append(int(j))
            links[int(j)].append(i)
    out, seen = normals.copy(), np.zeros(n, bool)
    for root in np.argsort(-points[:, 2], kind="stable"):
        if seen[root]:
            continue
        if out[root, 2] < 0:
            out[root] *= -1
        heap = [(0.0, int(root), int(root))]
        while heap:
            _, i, parent = heapq.heappop(heap)
            if seen[i]:
                continue
            seen[i] = True
            if out[i] @ out[parent] < 0:
                out[i] *= -1
            for j in links[i]:
                if not seen[j]:
                    heapq.heappush(heap, (1.0 - abs(float(out[i] @ normals[j])), j, i))
    return out


def orient_normals(points: DataFrame, k: int, by: str = "object") -> DataFrame:
    """Makes the normals of each object consistent over its ``k``-nearest graph; needs at least four points."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id").reset_index(drop=True)
        pdf[list(G.NORMAL)] = _orient(pdf[list(G.XYZ)].to_numpy(), pdf[list(G.NORMAL)].to_numpy(), k)
        return pdf

    return points.groupBy(by).applyInPandas(one, points.schema)


def _quadrics(xyz: np.ndarray, faces: np.ndarray) -> np.ndarray:
    a, b, c = (xyz[faces[:, i]] for i in range(3))
    normal = np.cross(b - a, c - a)
    area = np.linalg.norm(normal, axis=1, keepdims=True)
    normal = normal / np.maximum(area, 1e-300)
    plane = np.concatenate([normal, -(normal * a).sum(axis=1, keepdims=True)], axis=1)
    each = plane[:, :, None] * plane[:, None, :] * (area / 2)[:, :, None]
    out = np.zeros((len(xyz), 4, 4))
    for i in range(3):
        np.add.at(out, faces[:, i], each)
    return out


def _collapse(xyz: np.ndarray, faces: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edge collapses in the order of their quadric error until ``target`` faces are left: places, faces, kept vertices."""
    xyz, q = xyz.copy(), _quadrics(xyz, faces)
    live = {i: [int(v) for v in f] for i, f in enumerate(faces)}
    around: list[set[int]] = [set() for _ in range(len(xyz))]
    for i, f in live.items():
        for v in f:
            around[v].add(i)
    version = np.zeros(len(xyz), dtype=np.int64)

    def best(u: int, v: int) -> tuple[float, np.ndarray]:
        m = q[u] + q[v]
        spots = [xyz[u], xyz[v], (xyz[u] + xyz[v]) / 2]
        if abs(np.linalg.det(m[:3, :3])) > 1e-12:
            spots.append(np.linalg.solve(m[:3, :3], -m[:3, 3]))
        costs = [float(np.append(s, 1) @ m @ np.append(s, 1)) for s in spots]
        k = int(np.argmin(costs))
        return costs[k], spots[k]

    heap = []

    def push(u: int, v: int) -> None:
        cost, spot = best(u, v)
        heapq.heappush(heap, (cost, min(u, v), max(u, v), version[u] + version[v], tuple(spot)))

    for u, v in {(min(f[i], f[i - 1]), max(f[i], f[i - 1])) for f in live.values() for i in range(3)}:
        push(u, v)
    gone = np.zeros(len(xyz), bool)
    while len(live) > target and heap:
        _, u, v, stamp, spot = heapq.heappop(heap)
        if gone[u] or gone[v] or stamp != version[u] + version[v]:
            continue
        xyz[u], q[u], gone[v] = spot, q[u] + q[v], True
        version[u] += 1 + version[v]
        for i in list(around[v]):
            f = [u if w == v else w for w in live[i]]
            if len(set(f)) < 3:
                for w in set(live[i]):
                    around[w].discard(i)
                del live[i]
            else:
                live[i] = f
                around[u].add(i)
        around[v].clear()
        for w in {w for i in around[u] for w in live[i]} - {u}:
            push(u, w)
    return xyz, np.array(list(live.values()), dtype=np.int64).reshape(-1, 3), ~gone


def decimate(mesh: Mesh, target: int) -> Mesh:
    """Quadric edge collapse of every object with more than ``target`` triangles; an object is one task's work.

    Collapses are sequential by nature. Colours and other columns of vertices are not carried.
    """
    v = mesh.vertices.select("object", F.lit(0).alias("kind"), F.col("vid").alias("i"), *G.XYZ, *(F.lit(None).cast("long").alias(c) for c in ("v0", "v1", "v2")))
    t = mesh.triangles.select("object", F.lit(1).alias("kind"), F.col("tid").alias("i"), *(F.lit(None).cast("double").alias(c) for c in G.XYZ), "v0", "v1", "v2")
    both = v.unionByName(t)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        vs, ts = (pdf[pdf.kind == k].sort_values("i").reset_index(drop=True) for k in (0, 1))
        if len(ts) <= target:
            return pdf
        place = pd.Series(range(len(vs)), index=vs.i)
        faces = np.stack([place[ts[c].astype("int64")].to_numpy() for c in ("v0", "v1", "v2")], axis=1)
        xyz, faces, kept = _collapse(vs[list(G.XYZ)].to_numpy(), faces, target)
        vs[list(G.XYZ)] = xyz
        ids = vs.i.to_numpy()
        new = pd.DataFrame({"object": pdf.object.iloc[0], "kind": 1, "i": range(len(faces)), "x": np.nan, "y": np.nan, "z": np.nan} | {f"v{k}": ids[faces[:, k]] for k in range(3)})
        return pd.concat([vs[kept], new], ignore_index=True).astype({f"v{k}": "Int64" for k in range(3)})[pdf.columns]

    out = cut(both.groupBy("object").applyInPandas(one, both.schema))
    vertices = out.where("kind = 0").select("object", F.col("i").alias("vid"), *G.XYZ)
    return Mesh(vertices, out.where("kind = 1").select("object", F.col("i").alias("tid"), "v0", "v1", "v2"))


def reconstruct(points: DataFrame, p: Reconstruct, solver: Callable[[DataFrame, int, float], Mesh]) -> Mesh:
    """An object's points to a coloured mesh with normals. ``solver`` (points, depth, scale) gives a mesh with vertex ``density``.

    Low-density vertices go, then what lies outside the points' box or far from every
    point; the mesh is cleaned, for smoothed meshes also of bad triangles and small
    components, then it is decimated, smoothed and coloured. An object of fewer than
    ``min_points`` points has no mesh: the result has no rows.
    """
    ends = points.agg(F.count("*").alias("n"), *(f(c) for f in (F.min, F.max) for c in G.XYZ)).first()
    enough = points.where(F.lit(ends.n >= p.min_points))
    with_normals = cut(orient_normals(estimate_normals(enough, p.normal_radius, p.normal_neighbours), p.orient_neighbours))
    mesh = settled(remove_low_density(settled(solver(with_normals, p.depth, p.scale)), p.density_quantile))
    if ends.n < p.min_points:
        mesh = Mesh(mesh.vertices.limit(0), mesh.triangles.limit(0))
    else:
        mesh = settled(crop_mesh(mesh, ends[1:4], ends[4:7], p.crop_margin))
    mesh = settled(clean(settled(remove_far_vertices(mesh, points, p.vertex_distance))))
    if p.max_edge is not None:
        mesh = settled(remove_triangles(mesh, cut(bad_triangles(mesh, points, p.centre_distance, p.max_edge, centre_only=True))))
        mesh = settled(remove_small_components(mesh, p.component))
    mesh = settled(decimate(mesh, p.triangles))
    mesh = settled(taubin(mesh, p.taubin_steps)) if p.taubin_steps else mesh
    mesh = Mesh(transfer_colours(mesh.vertices, points, (0.6, 0.6, 0.6)), mesh.triangles)
    return Mesh(vertex_normals(mesh), mesh.triangles)
