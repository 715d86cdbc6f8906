"""DuckDB SQL of the spatial queries, written for clarity: all pairs where the operators use grids.

Each text is built from the parameters of ``queries``, so that the two cannot drift apart.
"""

from __future__ import annotations

import math

from pointloom.operators import boxes as B, labels as L, render as R, voxel as V
from pointloom.operators.cluster import tries
from pointloom.plans import queries as Q
from pointloom.plans.params import BoxFilter, DbscanAuto, Merge, Split

XYZ, RGB = "xyz", "rgb"
#: Colours of the labels 0 to 9, as written down from the published generator with the seed 0 (fixed values).
COLOURS = (
    (0.6369616873214543, 0.2697867137638703, 0.04097352393619469),
    (0.016527635528529094, 0.8132702392002724, 0.9127555772777217),
    (0.6066357757671799, 0.7294965609839984, 0.5436249914654229),
    (0.9350724237877682, 0.8158535541215322, 0.002738500170148095),
    (0.8574042765875693, 0.033585575305464355, 0.7296554464299441),
    (0.17565562060255901, 0.8631789223498866, 0.5414612202490917),
    (0.2997118905373848, 0.42268722119765845, 0.028319671145462966),
    (0.12428327649956394, 0.6706244146936303, 0.6471895115742501),
    (0.6153851114812539, 0.38367755426188344, 0.997209935789211),
    (0.9808353387762301, 0.6855419844806947, 0.6504592762678163),
)
#: Object labels and prompts, written out (fixed values).
OBJECTS = "bed|desk|chair|table|cabinet|shelf|drawer|sofa|monitor|box|trash bin|unknown furniture"
PROMPTS = ("a colored 3D scan of a ", "a colored point cloud rendering of a ", "a rendered view of a ", "a 3D object rendering of a ")

PTS = (
    "pts AS (SELECT vec_id AS point_id, "
    + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {c}" for i, c in enumerate(XYZ))
    + ", "
    + ", ".join(f"least(greatest(embedding[{i + 4}]::DOUBLE + 0.5::DOUBLE, 0), 1) AS {c}" for i, c in enumerate(RGB))
    + ", label FROM embeddings WHERE embedding[3] IS NOT NULL)"
)
HALVES = "lo AS (SELECT * FROM pts WHERE label < 5), hi AS (SELECT * FROM pts WHERE label >= 5)"


def d(value: float) -> str:
    """A number as a DOUBLE literal."""
    return f"{value!r}::DOUBLE"


def d2(a: str, b: str) -> str:
    return "(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in XYZ) + ")"


def sql(*parts: str) -> str:
    """CTEs, then the final SELECT."""
    *ctes, final = parts
    return f"WITH RECURSIVE {', '.join([PTS, *ctes])} {final}"


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, {Q.DECIMALS}) AS {n}" for n in names)


def cells(size: float, by: str = "", name: str = "vox", source: str = "pts") -> str:
    """Points with their cells, then the cells themselves."""
    part = f"PARTITION BY {by}" if by else ""
    origin = ", ".join(f"min({c}) OVER ({part}) - {d(size * 0.5)} AS o{c}" for c in XYZ)
    at = ", ".join(f"floor(({c} - o{c}) / {d(size)})::BIGINT AS i{c}" for c in XYZ)
    keys = (by + ", " if by else "") + "ix, iy, iz"
    rgb = ", ".join(f"avg({c}) AS {c}" for c in RGB)
    mean = ", ".join(f"avg({c}) AS m{c}" for c in XYZ)
    return (
        f"{name}_at AS (SELECT *, {at} FROM (SELECT *, {origin} FROM {source})), "
        f"{name} AS (SELECT {keys}, {mean}, {rgb}, count(*) AS n, any_value(ox) AS ox, any_value(oy) AS oy, any_value(oz) AS oz FROM {name}_at GROUP BY {keys})"
    )


OBJ = "obj AS (SELECT *, label AS object FROM pts)"
QUANT = ", ".join(f"round_even((least(greatest({c}, 0), 1) * {d(Q.LEVELS - 1)})::DOUBLE, 0)::INT AS q{c}" for c in RGB)


def faces(size: float) -> str:
    steps = ", ".join(f"({i}, {s[0]}, {s[1]}, {s[2]})" for i, (s, _) in enumerate(V.FACES))
    return (
        f"{OBJ}, {cells(size, 'object', 'vox', 'obj')}, qvox AS (SELECT *, 'mat_' || qr || '_' || qg || '_' || qb AS material FROM (SELECT *, {QUANT} FROM vox)), "
        f"steps(face, dx, dy, dz) AS (VALUES {steps}), "
        "faces AS (SELECT v.*, face FROM qvox v, steps s WHERE NOT EXISTS (SELECT 1 FROM vox w WHERE w.object = v.object "
        "AND w.ix = v.ix + dx AND w.iy = v.iy + dy AND w.iz = v.iz + dz))"
    )


def mesh(size: float) -> str:
    """vertices and triangles of the voxel mesh."""
    corners = ", ".join(f"({i}, {k}, {c[0]}, {c[1]}, {c[2]})" for i, (_, cs) in enumerate(V.FACES) for k, c in enumerate(cs))
    halves = ", ".join(f"({k}, {t[0]}, {t[1]}, {t[2]})" for k, t in enumerate(V.TRIANGLES))
    at = ", ".join(f"(f.o{c} + f.i{c} * {d(size)}) + c.c{c} * {d(size)} AS {c}" for c in XYZ)
    return (
        f"{faces(size)}, nf AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY ix, iy, iz, face) AS nth FROM faces), "
        f"corners(face, corner, cx, cy, cz) AS (VALUES {corners}), halves(k, h0, h1, h2) AS (VALUES {halves}), "
        f"vertices AS (SELECT object, 4 * (nth - 1) + corner AS vid, {at} FROM nf f JOIN corners c USING (face)), "
        "triangles AS (SELECT object, 2 * (nth - 1) + k AS tid, 4 * (nth - 1) + h0 AS v0, 4 * (nth - 1) + h1 AS v1, 4 * (nth - 1) + h2 AS v2, material, qr, qg, qb FROM nf, halves)"
    )


MESH = mesh(Q.MESH_SIZE)
WELD = (
    MESH + ", places AS (SELECT object, vid, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM vertices), "
    "weld AS (SELECT object, vid, min(vid) OVER (PARTITION BY object, x, y, z) AS to_vid, x, y, z FROM places), "
    "wv AS (SELECT object, vid, x, y, z FROM weld WHERE vid = to_vid), "
    "wt AS (SELECT t.object, t.tid, a.to_vid AS v0, b.to_vid AS v1, c.to_vid AS v2 FROM triangles t "
    + " ".join(f"JOIN weld {n} ON {n}.object = t.object AND {n}.vid = t.{v}" for n, v in (("a", "v0"), ("b", "v1"), ("c", "v2")))
    + ")"
)


def with_corners(triangles: str, vertices: str, name: str = "tri") -> str:
    places = ", ".join(f"{n}.{c} AS p{i}{c}" for i, n in enumerate("abc") for c in XYZ)
    joins = " ".join(f"JOIN {vertices} {n} ON {n}.object = t.object AND {n}.vid = t.v{i}" for i, n in enumerate("abc"))
    u, v = [f"(p1{c} - p0{c})" for c in XYZ], [f"(p2{c} - p0{c})" for c in XYZ]
    cross = [f"{u[1]} * {v[2]} - {u[2]} * {v[1]}", f"{u[2]} * {v[0]} - {u[0]} * {v[2]}", f"{u[0]} * {v[1]} - {u[1]} * {v[0]}"]
    edge = ", ".join("sqrt(" + " + ".join(f"(p{a}{c} - p{b}{c}) * (p{a}{c} - p{b}{c})" for c in XYZ) + ")" for a, b in ((0, 1), (1, 2), (2, 0)))
    return (
        f"{name}0 AS (SELECT t.*, {places} FROM {triangles} t {joins}), "
        f"{name}1 AS (SELECT *, {cross[0]} AS kx, {cross[1]} AS ky, {cross[2]} AS kz, greatest({edge}) AS max_edge FROM {name}0), "
        f"{name} AS (SELECT *, sqrt(kx * kx + ky * ky + kz * kz) AS size, sqrt(kx * kx + ky * ky + kz * kz) * 0.5::DOUBLE AS area FROM {name}1)"
    )


def closure(name: str, edges: str) -> str:
    """(node, component) by reachability over an undirected edge list (u, v) that has a loop at each node."""
    return (
        f"{name}_e AS (SELECT u, v FROM {edges} UNION SELECT v, u FROM {edges}), "
        f"{name}_r(node, seen) AS (SELECT u, u FROM {name}_e UNION SELECT r.node, e.v FROM {name}_r r JOIN {name}_e e ON e.u = r.seen), "
        f"{name} AS (SELECT node, min(seen) AS component FROM {name}_r GROUP BY node)"
    )


def dbscan(name: str, eps: float, min_points: int, source: str = "pts", by: str = "") -> str:
    """``name``: the source with core, cluster and label."""
    same = f"AND a.{by} = b.{by}" if by else ""
    near = f"{d2('a', 'b')} <= {d(eps * eps)} {same}"
    return (
        f"{name}_n AS (SELECT a.point_id, count(*) >= {min_points} AS core FROM {source} a JOIN {source} b ON {near} GROUP BY a.point_id), "
        f"{name}_p AS (SELECT s.*, n.core FROM {source} s JOIN {name}_n n USING (point_id)), "
        f"{name}_l AS (SELECT a.point_id AS u, b.point_id AS v FROM {name}_p a JOIN {name}_p b ON a.core AND b.core AND {near}), "
        f"{closure(name + '_c', name + '_l')}, "
        f"{name}_b AS (SELECT a.point_id, min(c.component) AS cluster FROM {name}_p a JOIN {name}_p b ON NOT a.core AND b.core AND {near} JOIN {name}_c c ON c.node = b.point_id GROUP BY a.point_id), "
        f"{name}_a AS (SELECT p.*, coalesce(c.component, b.cluster) AS cluster FROM {name}_p p LEFT JOIN {name}_c c ON c.node = p.point_id LEFT JOIN {name}_b b ON b.point_id = p.point_id), "
        f"{name} AS (SELECT *, CASE WHEN cluster IS NULL THEN -1 ELSE (dense_rank() OVER (ORDER BY cluster NULLS LAST) - 1)::INT END AS new_label FROM {name}_a)"
    )


BARE = "bare AS (SELECT * EXCLUDE (label) FROM pts)"


def auto(name: str, p: DbscanAuto) -> str:
    """``name``: the clustering of the first radius whose largest cluster is small enough, or of the last."""
    radii = tries(p)
    parts = [dbscan(f"{name}{i}", eps, p.min_points, "bare") for i, eps in enumerate(radii)]
    fraction = "coalesce((SELECT max(c) FROM (SELECT count(*) AS c FROM {t} WHERE new_label >= 0 GROUP BY new_label)), (SELECT count(*) FROM {t})) / (SELECT count(*) FROM {t})::DOUBLE"
    ok = ", ".join(f"{fraction.format(t=f'{name}{i}')} <= {d(p.max_fraction)} AS ok{i}" for i in range(len(radii)))
    pick = " ".join(f"WHEN ok{i} THEN {i}" for i in range(len(radii) - 1))
    chosen = " UNION ALL ".join(f"SELECT * FROM {name}{i} WHERE (SELECT pick FROM {name}_pick) = {i}" for i in range(len(radii)))
    return ", ".join([*parts, f"{name}_pick AS (SELECT CASE {pick or 'WHEN false THEN 0'} ELSE {len(radii) - 1} END AS pick FROM (SELECT {ok}))", f"{name} AS ({chosen})"])


def boxes(name: str, source: str, label: str = "label") -> str:
    bounds = ", ".join(f"min({c}) AS min{c}, max({c}) AS max{c}, avg({c}) AS mean{c}" for c in XYZ)
    extent = ", ".join(f"max{c} - min{c} AS extent{c}, (min{c} + max{c}) * 0.5::DOUBLE AS centre{c}" for c in XYZ)
    return f"{name}0 AS (SELECT {label} AS label, count(*) AS n, {bounds} FROM {source} GROUP BY 1), {name}1 AS (SELECT *, {extent} FROM {name}0), {name} AS (SELECT *, extentx * extenty * extentz AS volume FROM {name}1)"


def good(name: str, source: str, p: BoxFilter) -> str:
    return (
        f"{name} AS (SELECT * EXCLUDE (s) FROM (SELECT *, list_sort([extentx, extenty, extentz]) AS s FROM {source}) WHERE n >= {p.min_points} AND NOT (s[3] < {d(p.min_size)} "
        f"OR (s[1] < {d(p.thin_min)} AND s[3] * s[2] < {d(p.thin_keep_footprint)}) "
        f"OR (s[3] / (s[1] + 1e-9::DOUBLE) > {d(p.elong_ratio)} AND s[3] * s[2] < {d(p.elong_remove_footprint)})))"
    )


def merged(name: str, source: str, p: Merge) -> str:
    """``name`` (point_id, label): clusters of ``source`` (with label) merged where boxes nearly touch."""
    cell = ", ".join(f"floor((centre{c} - 0::DOUBLE) / {d(2 * p.distance)})::BIGINT AS c{c}" for c in XYZ)
    close = " AND ".join(f"abs(a.c{c} - b.c{c}) <= 1" for c in XYZ)
    gap = " + ".join("power(greatest(0, b.min{0} - a.max{0}, a.min{0} - b.max{0}), 2)".format(c) for c in XYZ)
    return (
        f"{boxes(name + '_x', f'(SELECT * FROM {source} WHERE label >= 0)')}, {name}_y AS (SELECT *, {cell} FROM {name}_x WHERE n >= {p.min_points}), "
        f"{name}_e AS (SELECT a.label AS u, b.label AS v FROM {name}_y a JOIN {name}_y b ON a.label = b.label OR (a.label < b.label AND {close} AND {gap} <= {d(p.distance * p.distance)})), "
        f"{closure(name + '_c', name + '_e')}, "
        f"{name}_m AS (SELECT s.point_id, CASE WHEN s.label < 0 THEN -1 ELSE coalesce(c.component + (SELECT max(label) + 1 FROM {source}), s.label) END AS l FROM {source} s LEFT JOIN {name}_c c ON c.node = s.label), "
        f"{name} AS (SELECT point_id, CASE WHEN l < 0 THEN -1 ELSE (dense_rank() OVER (ORDER BY CASE WHEN l >= 0 THEN l END NULLS LAST) - 1)::INT END AS label FROM {name}_m)"
    )


def bridges(name: str, source: str, p: Split) -> str:
    return (
        f"{name}_n AS (SELECT a.point_id, a.label, count(*) >= {p.min_neighbours} AS dense FROM {source} a JOIN {source} b ON a.label = b.label AND {d2('a', 'b')} <= {d(p.density_radius * p.density_radius)} GROUP BY 1, 2), "
        f"{name}_w AS (SELECT *, count(*) FILTER (dense) OVER (PARTITION BY label) AS k, count(*) OVER (PARTITION BY label) AS n FROM {name}_n), "
        f"{name} AS (SELECT point_id, label, NOT dense AND k >= {p.min_remain_points} AND k / n::DOUBLE >= {d(p.min_remain_fraction)} AS bridge FROM {name}_w)"
    )


def split(name: str, source: str, p: Split, base: float) -> str:
    """``name``: ``source`` with part and removed."""
    eps = max(p.sub_eps_min, base * p.sub_eps_ratio)
    return (
        f"{boxes(name + '_x', f'(SELECT * FROM {source} WHERE label >= 0)')}, "
        f"{name}_in AS (SELECT s.* FROM {source} s JOIN {name}_x x ON x.label = s.label WHERE x.n >= {p.min_points} AND (greatest(extentx, extenty, extentz) >= {d(p.max_extent)} OR volume >= {d(p.min_volume)})), "
        f"{bridges(name + '_g', name + '_in', p)}, {name}_d AS (SELECT i.* FROM {name}_in i JOIN {name}_g g USING (point_id) WHERE NOT g.bridge), "
        f"{dbscan(name + '_s', eps, p.sub_min_points, name + '_d', 'label')}, "
        f"{name}_z AS (SELECT label, cluster, row_number() OVER (PARTITION BY label ORDER BY cluster) - 1 AS part, count(*) OVER (PARTITION BY label) AS parts "
        f"FROM (SELECT label, cluster FROM {name}_s WHERE cluster IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {p.min_sub_cluster})), "
        f"{name}_k AS (SELECT s.point_id, z.part FROM {name}_s s JOIN {name}_z z ON z.label = s.label AND z.cluster = s.cluster WHERE z.parts >= 2), "
        f"{name}_v AS (SELECT DISTINCT label FROM {name}_z WHERE parts >= 2), "
        f"{name} AS (SELECT s.*, CASE WHEN v.label IS NULL THEN 0 ELSE k.part END AS part, v.label IS NOT NULL AND coalesce(g.bridge, false) AS removed "
        f"FROM {source} s LEFT JOIN {name}_v v ON v.label = s.label LEFT JOIN {name}_k k ON k.point_id = s.point_id LEFT JOIN {name}_g g ON g.point_id = s.point_id)"
    )


def _labelled(name: str, source: str) -> str:
    """A clustering as points with its labels."""
    return f"{name} AS (SELECT * EXCLUDE (core, cluster, new_label), new_label AS label FROM {source})"


def _nearest(name: str, columns: str = "") -> str:
    """The nearest point of ``hi`` to each of ``lo``, the least id among equals."""
    return (
        f"{name} AS (SELECT l.*, h.d2, h.hr, h.hg, h.hb FROM lo l, LATERAL (SELECT {d2('l', 'h')} AS d2, h.r AS hr, h.g AS hg, h.b AS hb FROM hi h ORDER BY {d2('l', 'h')}, h.point_id LIMIT 1) h)"
    )


def _rotation(v: list[str], m) -> list[str]:
    return [" + ".join(f"{a} * {d(k)}" for a, k in zip(v, row, strict=True)) for row in m]


def _align() -> dict[str, str]:
    a = Q.ALIGNMENT
    moved = _rotation([f"({c} - {d(o)})" for c, o in zip(XYZ, a.centroid, strict=True)], a.rotation)
    normal = _rotation(list(RGB), a.rotation)
    turned = _rotation(["ax", "ay", "az"], list(zip(*a.rotation, strict=True)))
    named = lambda values, names: ", ".join(f"round({v}, 6) AS {n}" for v, n in zip(values, names, strict=True))
    back = [f"({v}) + {d(o)}" for v, o in zip(turned, a.centroid, strict=True)]
    at = ", ".join(f"{v} AS a{c}" for v, c in zip(moved, XYZ, strict=True))
    return {
        "rigid_align": sql(f"SELECT point_id, {named(moved, XYZ)}, {named(normal, ('nx', 'ny', 'nz'))} FROM pts"),
        "rigid_roundtrip": sql(f"t AS (SELECT point_id, {at} FROM pts)", f"SELECT point_id, {named(back, XYZ)} FROM t"),
    }


def _voxels() -> dict[str, str]:
    counts = (
        "c AS (SELECT object, sum(n)::BIGINT AS points, count(*) AS voxels, count(DISTINCT material) AS materials FROM qvox GROUP BY object), "
        "f AS (SELECT object, count(*) AS k FROM faces GROUP BY object)"
    )
    measures = "(SELECT l_quantity::DOUBLE AS x, (l_discount * 100)::DOUBLE AS y, (l_tax * 100)::DOUBLE AS z, 0::DOUBLE AS r, 0::DOUBLE AS g, 0::DOUBLE AS b FROM lineitem)"
    mean = ", ".join(f"round(m{c}, 6) AS {c}" for c in XYZ)
    middle = ", ".join(f"round({c} - avg({c}) OVER (PARTITION BY object), 6) AS {c}" for c in XYZ)
    return {
        "voxel_downsample": sql(cells(Q.SIZE), f"SELECT ix, iy, iz, {mean}, {rounded(*RGB)}, n FROM vox"),
        "voxel_grid": sql(OBJ, cells(Q.SIZE, "object", "vox", "obj"), f"SELECT object, ix, iy, iz, {rounded(*RGB)}, n FROM vox"),
        "exposed_faces": sql(faces(Q.SIZE), "SELECT object, ix, iy, iz, face FROM faces"),
        "voxel_mesh_counts": sql(faces(Q.SIZE), counts, "SELECT object, points, voxels, 4 * k AS vertices, 2 * k AS triangles, materials FROM c JOIN f USING (object)"),
        "voxel_mesh_vertices": sql(mesh(Q.SIZE), f"SELECT object, vid, {rounded(*XYZ)} FROM vertices"),
        "voxel_mesh_triangles": sql(mesh(Q.SIZE), "SELECT * FROM triangles"),
        "centred_mesh": sql(MESH, f"SELECT object, vid, {middle} FROM vertices"),
        "color_quantize": sql(f"q AS (SELECT point_id, {QUANT} FROM pts)", "SELECT *, 'mat_' || qr || '_' || qg || '_' || qb AS material FROM q"),
        "lineitem_voxels": sql(cells(2.5, "", "vox", measures), f"SELECT ix, iy, iz, {mean}, n FROM vox"),
        "lineitem_boxes": "SELECT l_returnflag AS label, count(*) AS n, "
        + ", ".join(f"min({s}) AS min{c}, max({s}) AS max{c}" for c, s in zip(XYZ, ("l_quantity", "l_discount", "l_tax"), strict=True))
        + ", round(quantile_cont(l_discount, 0.01), 6) AS p01 FROM lineitem GROUP BY 1",
    }


def _boxes() -> dict[str, str]:
    kept = (*B.LOW, *B.HIGH, *B.EXTENT, *B.CENTRE, "volume", "meanx", "meany", "meanz")
    coarse = f"{cells(0.3)}, named AS (SELECT * EXCLUDE (label), ix || '_' || iy || '_' || iz AS label FROM vox_at)"
    wide = ", ".join(f"round(min{c} - 0.05::DOUBLE, 6) AS min{c}, round(max{c} + 0.05::DOUBLE, 6) AS max{c}, round((max{c} + 0.05::DOUBLE) - (min{c} - 0.05::DOUBLE), 6) AS extent{c}" for c in XYZ)
    inside = " AND ".join(f"{c} BETWEEN {d(lo - 0.03)} AND {d(hi + 0.03)}" for c, lo, hi in zip(XYZ, (-0.1, -0.1, -0.1), (0.1, 0.15, 0.2), strict=True))
    numbered = "SELECT *, row_number() OVER (ORDER BY label)::INT AS seq FROM {t}"
    ends = ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(B.CORNERS))
    lines = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(B.EDGES))
    spot = ", ".join(f"round(CASE WHEN e{c} = 1 THEN max{c} ELSE min{c} END, 6) AS {c}" for c in XYZ)
    rgb = ", ".join(f"{d(v)} AS {c}" for v, c in zip(B.RED, RGB, strict=True))
    return {
        "cluster_aabb": sql(boxes("bx", "pts"), f"SELECT label, n, {rounded(*kept)} FROM bx"),
        "bbox_filter": sql(coarse, boxes("bx", "named"), good("ok", "bx", Q.BOXES), "SELECT label, n FROM ok"),
        "big_clusters": sql(coarse, boxes("bx", "named"), f"SELECT label, n >= 12 AND (greatest(extentx, extenty, extentz) >= {d(0.28)} OR volume >= {d(0.015)}) AS is_big FROM bx"),
        "expand_boxes": sql(boxes("bx", "pts"), f"SELECT label, {wide} FROM bx"),
        "crop_points": sql(f"SELECT point_id FROM pts WHERE {inside}"),
        "object_numbering": sql(boxes("bx", "pts"), f"SELECT label, seq, 'object_' || lpad(seq::VARCHAR, 3, '0') AS object_name FROM ({numbered.format(t='bx WHERE n >= 45')})"),
        "aabb_lineset_vertices": sql(
            boxes("bx", "pts"), f"nb AS ({numbered.format(t='bx')})", f"ends(i, ex, ey, ez) AS (VALUES {ends})", f"SELECT 8 * (seq - 1)::BIGINT + i AS vid, {spot} FROM nb, ends"
        ),
        "aabb_lineset_edges": sql(
            boxes("bx", "pts"), f"nb AS ({numbered.format(t='bx')})", f"lines(i, a, b) AS (VALUES {lines})", f"SELECT 12 * (seq - 1)::BIGINT + i AS eid, 8 * (seq - 1)::BIGINT + a AS v0, 8 * (seq - 1)::BIGINT + b AS v1, {rgb} FROM nb, lines"
        ),
        "point_numbering": sql("SELECT point_id, row_number() OVER (PARTITION BY label ORDER BY x, point_id) AS nth FROM pts"),
        "label_compaction": sql(
            "g AS (SELECT point_id, CASE WHEN label % 3 <> 0 THEN label * 7 END AS l FROM pts)",
            "SELECT point_id, CASE WHEN l IS NULL THEN -1 ELSE (dense_rank() OVER (ORDER BY l NULLS LAST) - 1)::INT END AS label FROM g",
        ),
    }


def _neighbours() -> dict[str, str]:
    r2 = d(Q.RADIUS * Q.RADIUS)
    near = f"near AS (SELECT a.point_id, a.label, count(*) AS n_near FROM pts a JOIN pts b ON {d2('a', 'b')} <= {r2} GROUP BY 1, 2)"
    within = f"SELECT l.point_id, {{v}} FROM lo l LEFT JOIN hi h ON {d2('l', 'h')} <= {r2} GROUP BY l.point_id"
    rates = ", ".join(f"round(avg((dist <= {d(r)})::INT), 6) AS within_{i}" for i, r in enumerate((0.05, 0.08, 0.1)))
    quantiles = ", ".join(f"round(quantile_cont(dist, {q}), 6) AS {n}" for n, q in (("median", 0.5), ("p90", 0.9), ("p95", 0.95)))
    near5 = f"e AS (SELECT a.point_id AS u, b.point_id AS v FROM pts a JOIN pts b ON {d2('a', 'b')} <= {d(0.05 * 0.05)})"
    return {
        "radius_count": sql(near, "SELECT point_id, n_near FROM near"),
        "radius_outlier": sql(near, "SELECT point_id, n_near > 10 AS keep FROM near"),
        "outlier_counts": sql(near, "SELECT label, count(*) AS before, count(*) FILTER (n_near > 10) AS kept, count(*) FILTER (n_near <= 10) AS removed FROM near GROUP BY label"),
        "bridge_cut": sql(bridges("g", "pts", Q.SPLIT), "SELECT point_id, bridge FROM g"),
        "near_distance": sql(HALVES, within.format(v=f"round(sqrt(min({d2('l', 'h')})), 6) AS distance")),
        "nn_distance": sql(HALVES, _nearest("nn"), "SELECT point_id, round(sqrt(d2), 6) AS distance FROM nn"),
        "structure_anti_join": sql(HALVES, f"SELECT point_id FROM lo l WHERE NOT EXISTS (SELECT 1 FROM hi h WHERE {d2('l', 'h')} <= {r2})"),
        "removed_points": sql(HALVES, f"SELECT point_id FROM lo l WHERE EXISTS (SELECT 1 FROM hi h WHERE {d2('l', 'h')} <= {r2})"),
        "match_rate": sql(HALVES, _nearest("nn"), f"SELECT round(avg(dist), 6) AS mean, {quantiles}, {rates} FROM (SELECT sqrt(d2) AS dist FROM nn)"),
        "color_transfer": sql(HALVES, _nearest("nn"), "SELECT point_id, round(hr, 6) AS r, round(hg, 6) AS g, round(hb, 6) AS b FROM nn"),
        "components": sql(near5, closure("cc", "e"), "SELECT node AS point_id, component FROM cc"),
    }


def _clusters() -> dict[str, str]:
    labels = dbscan("db", Q.EPS, Q.MIN_POINTS, "bare")
    s = Q.STRUCTURE
    small = (
        f"min{s.height_axis} - (SELECT quantile_cont({s.height_axis}, {s.floor_percentile / 100}) FROM pts) >= {d(s.float_gap)} "
        f"AND n <= {s.float_max_points} AND greatest(extentx, extenty, extentz) <= {d(s.float_max_extent)}"
    )
    one = dbscan("db", 0.06, 5, "bare")
    found = f"{auto('au', Q.AUTO)}, {_labelled('pt', 'au')}, {boxes('bx', '(SELECT * FROM pt WHERE label >= 0)')}, {good('ok', 'bx', Q.OBJECT_BOXES)}"
    any_box = BoxFilter(5, 0.01, 0.0, 0.0, 1e9, 0.0)
    parted = (
        f"{dbscan('db', 0.12, 5, 'bare')}, {_labelled('pt', 'db')}, {split('sp', 'pt', Q.SPLIT, 0.12)}, "
        "re AS (SELECT * EXCLUDE (label, part, removed), (dense_rank() OVER (ORDER BY label, part) - 1)::INT AS label FROM sp WHERE label >= 0 AND part IS NOT NULL)"
    )
    return {
        "dbscan_labels": sql(BARE, labels, "SELECT point_id, core, cluster, new_label AS label FROM db"),
        "dbscan_groups": sql(OBJ, dbscan("db", 0.15, 5, "obj", "object"), "SELECT point_id, core, cluster, new_label AS label FROM db"),
        "dbscan_auto": sql(BARE, auto("au", Q.AUTO), "SELECT point_id, new_label AS label FROM au"),
        "dbscan_auto_floor": sql(BARE, auto("au", Q.AUTO_FLOOR), "SELECT point_id, new_label AS label FROM au"),
        "cluster_fraction": sql(
            BARE, labels, "c AS (SELECT new_label, count(*) AS n FROM db GROUP BY 1)", "SELECT round(coalesce(max(n) FILTER (new_label >= 0) / sum(n), 1), 6) AS fraction, count(*) FILTER (new_label >= 0) AS clusters FROM c"
        ),
        "floor_percentile": sql("SELECT label, round(quantile_cont(y, 0.01), 6) AS low, round(quantile_cont(y, 0.99), 6) AS high FROM pts GROUP BY label"),
        "floating_clusters": sql(
            BARE, dbscan("db", s.float_eps, s.float_min_points, "bare"), _labelled("pt", "db"), boxes("bx", "(SELECT * FROM pt WHERE label >= 0)"),
            f"gone AS (SELECT label FROM bx WHERE {small})", "SELECT point_id, label, label IN (SELECT label FROM gone) AS floating FROM pt",
        ),
        "merge_clusters": sql(BARE, one, _labelled("pt", "db"), merged("mg", "pt", Q.MERGE), "SELECT point_id, label FROM mg"),
        "split_clusters": sql(BARE, dbscan("db", 0.12, 5, "bare"), _labelled("pt", "db"), split("sp", "pt", Q.SPLIT, 0.12), "SELECT point_id, label, part::INT AS part, removed FROM sp"),
        "detect_objects": sql(
            BARE, found, "nb AS (SELECT *, row_number() OVER (ORDER BY label)::INT AS seq FROM ok)", f"SELECT 'object_' || lpad(seq::VARCHAR, 3, '0') AS object_name, seq, label, n, {rounded(*B.LOW, *B.HIGH)} FROM nb"
        ),
        "detect_merged": sql(
            BARE, one, _labelled("pt", "db"), merged("mg", "pt", Q.MERGE), "full_ AS (SELECT p.* EXCLUDE (label), m.label FROM pt p JOIN mg m USING (point_id))",
            boxes("bx", "(SELECT * FROM full_ WHERE label >= 0)"), good("ok", "bx", Q.OBJECT_BOXES), "SELECT point_id, label FROM full_ WHERE label IN (SELECT label FROM ok)",
        ),
        "detect_split": sql(BARE, parted, boxes("bx", "re"), good("ok", "bx", any_box), "SELECT point_id, label FROM re WHERE label IN (SELECT label FROM ok)"),
        "remove_structure": _remove_structure(),
    }


def _remove_structure() -> str:
    s = Q.STRUCTURE
    pick = ", ".join(f"m{c} AS {c}" for c in XYZ)
    return sql(
        HALVES, cells(s.voxel, "", "va", "lo"), cells(s.voxel, "", "vb", "hi"),
        f"room AS (SELECT {pick}, row_number() OVER (ORDER BY ix, iy, iz) AS point_id FROM va)", f"walls AS (SELECT {pick} FROM vb)",
        f"kept AS (SELECT * FROM room r WHERE NOT EXISTS (SELECT 1 FROM walls w WHERE {d2('r', 'w')} <= {d(s.remove_radius * s.remove_radius)}))",
        f"calm AS (SELECT a.* FROM kept a JOIN kept b ON {d2('a', 'b')} <= {d(s.outlier_radius * s.outlier_radius)} GROUP BY ALL HAVING count(*) > {s.outlier_points})",
        dbscan("db", s.float_eps, s.float_min_points, "calm"), _labelled("pt", "db"), boxes("bx", "(SELECT * FROM pt WHERE label >= 0)"),
        f"gone AS (SELECT label FROM bx WHERE min{s.height_axis} - (SELECT quantile_cont({s.height_axis}, {s.floor_percentile / 100}) FROM room) >= {d(s.float_gap)} "
        f"AND n <= {s.float_max_points} AND greatest(extentx, extenty, extentz) <= {d(s.float_max_extent)})",
        f"SELECT point_id, {rounded(*XYZ)} FROM pt WHERE label NOT IN (SELECT label FROM gone)",
    )


def _colours() -> dict[str, str]:
    # The first ten rows of a table of random numbers from the seed 0 (fixed values).
    table = ", ".join(f"({i}, {r}::DOUBLE, {g}::DOUBLE, {b}::DOUBLE)" for i, (r, g, b) in enumerate(COLOURS))
    scaled = ", ".join(f"CASE WHEN label % 2 = 0 THEN {c} ELSE {c} * 255 END AS {c}" for c in RGB)
    to_byte = ", ".join(f"trunc(least(greatest(CASE WHEN most <= 1 THEN {c} * 255 ELSE {c} END, 0), 255))::INT AS {c}" for c in RGB)
    grey = ", ".join(f"round(coalesce(k.{c}, 0.2), 6) AS {c}" for c in RGB)
    painted = ", ".join(f"round(CASE WHEN label < 5 THEN {d(v)} END, 6) AS {c}" for c, v in zip(RGB, (1.0, 0.0, 0.0), strict=True))
    stats = ", ".join(f"round(min({c}), 6) AS min{c}, round(max({c}), 6) AS max{c}, round(avg({c}), 6) AS mean{c}" for c in XYZ)
    return {
        "color_labels": sql(f"k(label, r, g, b) AS (VALUES {table})", f"SELECT p.point_id, {grey} FROM pts p LEFT JOIN k ON k.label = p.label AND p.label <> 9"),
        "byte_colors": sql(f"s AS (SELECT point_id, label, {scaled} FROM pts)", "m AS (SELECT *, max(greatest(r, g, b)) OVER (PARTITION BY label) AS most FROM s)", f"SELECT point_id, {to_byte} FROM m"),
        "select_points": sql("SELECT point_id FROM pts WHERE x > 0"),
        "concat_clouds": sql(f"SELECT point_id, {painted} FROM pts"),
        "cloud_bounds": sql(f"SELECT {stats}, count(*) AS n FROM pts"),
        "normalize_points": sql(_normalised("nm", "pts", "label"), f"SELECT point_id, {rounded(*XYZ)} FROM nm"),
        "density_quantile": sql("SELECT point_id, r < (SELECT quantile_cont(r, 0.08) FROM pts) AS low FROM pts"),
    }


def _normalised(name: str, source: str, by: str) -> str:
    centred = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {by}) AS {c}" for c in XYZ)
    scale = "CASE WHEN reach > 1e-8 THEN reach ELSE 1 END"
    scaled = ", ".join(f"{c} / {scale} AS {c}" for c in XYZ)
    return (
        f"{name}0 AS (SELECT * EXCLUDE (x, y, z), {centred} FROM {source}), "
        f"{name}1 AS (SELECT *, max(sqrt(x * x + y * y + z * z)) OVER (PARTITION BY {by}) AS reach FROM {name}0), {name} AS (SELECT * EXCLUDE (x, y, z), {scaled} FROM {name}1)"
    )


def _meshes() -> dict[str, str]:
    unit = ", ".join(f"round(CASE WHEN size > 0 THEN k{c} / size ELSE 0 END, 6) AS n{c}" for c in XYZ)
    raw_unit = ", ".join(f"CASE WHEN size > 0 THEN k{c} / size ELSE 0 END AS u{c}" for c in XYZ)
    total = ", ".join(f"coalesce(sum(u{c}), 0) AS s{c}" for c in XYZ)
    damaged = (
        "dm AS (SELECT object, tid, v0, v1, v2 FROM triangles UNION ALL SELECT object, tid + 1000000, v1, v2, v0 FROM triangles WHERE tid % 5 = 0 "
        "UNION ALL SELECT object, tid + 2000000, v0, v1, v0 FROM triangles WHERE tid % 7 = 0)"
    )
    turned = "CASE WHEN v0 = least(v0, v1, v2) THEN [v0, v1, v2] WHEN v1 = least(v0, v1, v2) THEN [v1, v2, v0] ELSE [v2, v0, v1] END"
    gone = "gone AS (SELECT object, vid FROM vertices WHERE x > 0)"
    left = "rest AS (SELECT t.* FROM triangles t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.object = t.object AND g.vid IN (t.v0, t.v1, t.v2)))"
    rank = "idx AS (SELECT object, vid, row_number() OVER (PARTITION BY object ORDER BY vid) - 1 AS nv FROM (SELECT DISTINCT object, unnest([v0, v1, v2]) AS vid FROM rest))"
    spots = [[f"(p0{c} + p1{c} + p2{c}) / 3::DOUBLE" for c in XYZ]] + [[f"(p{a}{c} + p{b}{c}) / 2::DOUBLE" for c in XYZ] for a, b in ((0, 1), (1, 2), (2, 0))]
    sample = lambda ss: "smp AS (" + " UNION ALL ".join(f"SELECT object, tid, {s[0]} AS x, {s[1]} AS y, {s[2]} AS z FROM tri" for s in ss) + ")"
    empty = lambda r: f"empty_ AS (SELECT DISTINCT object, tid FROM smp s WHERE NOT EXISTS (SELECT 1 FROM pts p WHERE {d2('s', 'p')} <= {d(r * r)}))"
    edges = "eg AS (SELECT object, tid, unnest([[least(v0, v1), greatest(v0, v1)], [least(v1, v2), greatest(v1, v2)], [least(v2, v0), greatest(v2, v0)]]) AS e FROM wt)"
    links = "lk AS (SELECT DISTINCT a.object * 1000000 + a.tid AS u, b.object * 1000000 + b.tid AS v FROM eg a JOIN eg b ON a.object = b.object AND a.e = b.e)"
    comps = f"{edges}, {links}, {closure('cc', 'lk')}, cs AS (SELECT (node // 1000000)::INT AS object, node % 1000000 AS tid, component % 1000000 AS component FROM cc)"
    sizes = "sz AS (SELECT object, component, count(*) AS n FROM cs GROUP BY 1, 2)"
    pair = "pr AS (SELECT DISTINCT object, e[1] AS a, e[2] AS b FROM eg UNION SELECT DISTINCT object, e[2], e[1] FROM eg)"

    def smooth(name: str, source: str, factor: float) -> str:
        weight = f"1 / (sqrt({d2('s', 'q')}) + 1e-12)"
        moved = ", ".join(f"coalesce(any_value(s.{c}) + {d(factor)} * (sum({weight} * q.{c}) / sum({weight}) - any_value(s.{c})), any_value(s.{c})) AS {c}" for c in XYZ)
        return f"{name} AS (SELECT s.object, s.vid, {moved} FROM {source} s LEFT JOIN pr ON pr.object = s.object AND pr.a = s.vid LEFT JOIN {source} q ON q.object = pr.object AND q.vid = pr.b GROUP BY s.object, s.vid)"

    return {
        "triangle_shape": sql(MESH, with_corners("triangles", "vertices"), "SELECT object, tid, round(max_edge, 6) AS max_edge, round(area, 6) AS area FROM tri"),
        "triangle_normals": sql(MESH, with_corners("triangles", "vertices"), f"SELECT object, tid, {unit} FROM tri"),
        "vertex_normals": sql(
            WELD, with_corners("wt", "wv"), f"un AS (SELECT object, unnest([v0, v1, v2]) AS vid, {raw_unit} FROM tri)", f"sm AS (SELECT object, vid, {total} FROM un GROUP BY 1, 2)",
            "ln AS (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS l FROM sm)", "SELECT object, vid, " + ", ".join(f"round(CASE WHEN l > 0 THEN s{c} / l ELSE 0 END, 6) AS n{c}" for c in XYZ) + " FROM ln",
        ),
        "mesh_weld": sql(WELD, "SELECT object, tid, v0, v1, v2 FROM wt"),
        "mesh_repair": sql(MESH, damaged, f"SELECT object, min(tid) AS tid FROM dm WHERE v0 <> v1 AND v1 <> v2 AND v2 <> v0 GROUP BY object, {turned}"),
        "mesh_reindex": sql(
            MESH, gone, left, rank, "SELECT r.object, row_number() OVER (PARTITION BY r.object ORDER BY tid) - 1 AS tid, a.nv AS v0, b.nv AS v1, c.nv AS v2 FROM rest r "
            + " ".join(f"JOIN idx {n} ON {n}.object = r.object AND {n}.vid = r.{v}" for n, v in (("a", "v0"), ("b", "v1"), ("c", "v2"))),
        ),
        "remove_vertices": sql(MESH, gone, left, "SELECT object, tid FROM rest"),
        "remove_far_vertices": sql(MESH, f"SELECT object, vid FROM vertices v WHERE EXISTS (SELECT 1 FROM pts p WHERE {d2('v', 'p')} <= {d(0.15 * 0.15)})"),
        "bad_triangles": sql(MESH, with_corners("triangles", "vertices"), sample(spots), empty(Q.SAMPLE), f"SELECT object, tid FROM tri WHERE max_edge > {d(Q.EDGE)} OR area > {d(Q.AREA)} UNION SELECT object, tid FROM empty_"),
        "long_triangles": sql(MESH, with_corners("triangles", "vertices"), sample(spots[:1]), empty(0.15), f"SELECT object, tid FROM tri WHERE max_edge > {d(0.3)} UNION SELECT object, tid FROM empty_"),
        "mesh_components": sql(WELD, comps, sizes, "SELECT object, component, n FROM sz"),
        "small_components": sql(WELD, comps, sizes, "SELECT cs.object, cs.tid FROM cs JOIN sz ON sz.object = cs.object AND sz.component = cs.component WHERE n >= 40"),
        "largest_component": sql(
            WELD, comps, sizes, "bg AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY n DESC, component) AS k FROM sz)",
            "SELECT cs.object, cs.tid FROM cs JOIN bg ON bg.object = cs.object AND bg.component = cs.component WHERE k = 1",
        ),
        "taubin_step": sql(WELD, edges, pair, smooth("s1", "wv", 0.5), smooth("s2", "s1", -0.53), f"SELECT object, vid, {rounded(*XYZ)} FROM s2"),
        "combine_meshes": sql(
            MESH, "pl AS (SELECT object, vid, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM vertices)",
            "ids AS (SELECT object, vid, dense_rank() OVER (ORDER BY x, y, z) AS p FROM pl)",
            "tt AS (SELECT a.p AS v0, b.p AS v1, c.p AS v2 FROM triangles t " + " ".join(f"JOIN ids {n} ON {n}.object = t.object AND {n}.vid = t.{v}" for n, v in (("a", "v0"), ("b", "v1"), ("c", "v2"))) + ")",
            f"un AS (SELECT DISTINCT {turned} AS t FROM tt WHERE v0 <> v1 AND v1 <> v2 AND v2 <> v0)", "at_ AS (SELECT DISTINCT p, x, y, z FROM pl JOIN ids USING (object, vid))",
            "SELECT " + ", ".join(f"a{i}.{c} AS {c}{i}" for i in range(3) for c in XYZ) + " FROM un " + " ".join(f"JOIN at_ a{i} ON a{i}.p = t[{i + 1}]" for i in range(3)),
        ),
    }


def _views() -> str:
    rows = ", ".join(
        f"('{v}', {d(math.cos(math.radians(y)))}, {d(math.sin(math.radians(y)))}, {d(math.cos(math.radians(p)))}, {d(math.sin(math.radians(p)))})" for v, y, p in R.VIEWS
    )
    return (
        f"views(view, cy, sy, cp, sp) AS (VALUES {rows}), "
        "yawed AS (SELECT p.*, v.*, cy * x + sy * z AS x1, cy * z - sy * x AS z1 FROM pts p, views v), "
        "turned AS (SELECT * EXCLUDE (x, y, z, x1, z1, cy, sy, cp, sp), x1 AS x, cp * y - sp * z1 AS y, sp * y + cp * z1 AS z FROM yawed)"
    )


def _pictures() -> dict[str, str]:
    size, radius = 32, 1
    disc = ", ".join(f"({a}, {b})" for a, b in R.disc(radius))
    last = d(size - 1)
    n = len(L.LABELS) * len(L.TEMPLATES)
    prompts = ", ".join(f"({4 * i + j}, {i}, '{label}', '{start}{label}')" for i, label in enumerate(OBJECTS.split("|")) for j, start in enumerate(PROMPTS))
    scores = (
        f"pm(prompt_id, label_pos, label, prompt) AS (VALUES {prompts}), "
        f"lg AS (SELECT label AS object, 'v' || (point_id % 4) AS view, (point_id % {n})::INT AS prompt_id, max(x) AS logit FROM pts GROUP BY 1, 2, 3), "
        "ex AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY object, view)) AS e FROM lg), "
        "pb AS (SELECT *, e / sum(e) OVER (PARTITION BY object, view) AS prob FROM ex), "
        "pv AS (SELECT object, view, label_pos, pm.label, avg(prob) AS s FROM pb JOIN pm USING (prompt_id) GROUP BY 1, 2, 3, 4), "
        "mn AS (SELECT object, label_pos, label, avg(s) AS s FROM pv GROUP BY 1, 2, 3), "
        "sc AS (SELECT object, label_pos, label, round(s / sum(s) OVER (PARTITION BY object), 6) AS score FROM mn)"
    )
    top = ", ".join(f"max(label) FILTER (k = {i}) AS top{i}_label, max(score) FILTER (k = {i}) AS top{i}_score" for i in (1, 2, 3))
    bytes_ = ", ".join(f"trunc(least(greatest({c} * 255, 0), 255))::INT AS {c}" for c in RGB)
    area = (
        "flat AS (SELECT point_id, label, x, y, 0::DOUBLE AS z FROM pts), " + _normalised("nm", "flat", "label") + ", "
        "od AS (SELECT *, row_number() OVER w AS k, lead(x) OVER w AS x2, lead(y) OVER w AS y2, first_value(x) OVER w AS xf, first_value(y) OVER w AS yf "
        "FROM nm WINDOW w AS (PARTITION BY label ORDER BY round(atan2(y, x), 9), point_id)), st AS (SELECT *, coalesce(x2, xf) AS xn, coalesce(y2, yf) AS yn FROM od)"
    )
    return {
        "rotate_views": sql(_views(), f"SELECT point_id, view, {rounded(*XYZ)} FROM turned"),
        "render_pixels": sql(
            _views(), _normalised("nm", "(SELECT *, label AS object FROM turned)", "label, view"),
            f"px AS (SELECT object, view, point_id, z, {bytes_}, least(greatest(trunc((x + 1) * 0.5 * {last})::INT, 0), {size - 1}) AS px, least(greatest(trunc((1 - (y + 1) * 0.5) * {last})::INT, 0), {size - 1}) AS py FROM nm)",
            f"dc(dx, dy) AS (VALUES {disc})", "dr AS (SELECT * EXCLUDE (px, py), px + dx AS px, py + dy AS py FROM px, dc)",
            "tp AS (SELECT *, row_number() OVER (PARTITION BY object, view, px, py ORDER BY z DESC, point_id DESC) AS k FROM dr "
            f"WHERE px BETWEEN 0 AND {size - 1} AND py BETWEEN 0 AND {size - 1})", "SELECT object, view, px, py, r, g, b FROM tp WHERE k = 1",
        ),
        "label_prompts": f"SELECT * FROM (VALUES {prompts}) t(prompt_id, label_pos, label, prompt)",
        "label_scores": sql(scores, "SELECT * FROM sc"),
        "top_labels": sql(scores, "rk AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY score DESC, label_pos) AS k FROM sc)", f"SELECT object, {top} FROM rk GROUP BY object"),
        "polygon_area": sql(
            area, "SELECT label, round(abs(sum(x * yn - xn * y)) / 2, 6) AS area, round(sum(sqrt((xn - x) * (xn - x) + (yn - y) * (yn - y))), 6) AS perimeter, count(*) AS corners FROM st GROUP BY label"
        ),
    }


def oracle_sql() -> dict[str, str]:
    """SQL by query name. Eigenvectors, decimation and repeated deletion have none."""
    return _voxels() | _align() | _boxes() | _neighbours() | _clusters() | _colours() | _meshes() | _pictures()
