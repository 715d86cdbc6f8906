"""DuckDB SQL of the queries that write files and read them again."""

from __future__ import annotations

from pointloom.operators import boxes as B, render as R
from pointloom.plans import file_queries as FQ, queries as Q
from pointloom.plans.oracles import HALVES, RGB, XYZ, boxes, d, d2, mesh, rounded, sql

BYTE = "round_even(least(greatest({c}, 0), 1) * 255, 0)"


def _xyz(prefix: str, values: str) -> str:
    """x, y and z of a nested value, as the query flattens them; ``values`` has {c} for the axis."""
    return ", ".join(f"round({values.format(c=c)}, {Q.DECIMALS}) AS {prefix}_{c}" for c in XYZ)


def _points() -> dict[str, str]:
    nth = "(row_number() OVER (ORDER BY point_id) - 1)"
    at = ", ".join(f"round({c}, 6) AS {c}" for c in XYZ)
    shades = ", ".join(f"round({BYTE.format(c=c)} / 255::DOUBLE, 6) AS {c}" for c in RGB)
    near = f"gone AS (SELECT * FROM lo l WHERE EXISTS (SELECT 1 FROM hi h WHERE {d2('l', 'h')} <= {d(Q.RADIUS * Q.RADIUS)}))"
    text = ", ".join(f"format('{{:.8f}}', {c}) AS {c}" for c in XYZ)
    a = Q.ALIGNMENT
    moved = [" + ".join(f"({c} - {d(o)}) * {d(k)}" for c, o, k in zip(XYZ, a.centroid, row, strict=True)) for row in a.rotation]
    cell = ", ".join(f"floor({c} / {d(FQ.STREAM_SIZE)})::BIGINT AS i{c}" for c in XYZ)
    mean = ", ".join(f"round(avg({c}), 6) AS {c}" for c in XYZ)
    return {
        "file_points": sql(f"SELECT 'cloud' AS object, {nth} AS point_id, {at}, {shades} FROM pts"),
        "file_removed": sql(HALVES, near, f"SELECT 'removed' AS object, {nth} AS point_id, {at}, 1::DOUBLE AS r, 0::DOUBLE AS g, 0::DOUBLE AS b FROM gone"),
        "file_xyz": sql(f"SELECT label, {text} FROM pts"),
        "file_alignment": sql("SELECT point_id, " + ", ".join(f"round({v}, 6) AS {c}" for v, c in zip(moved, XYZ, strict=True)) + " FROM pts"),
        "voxel_stream": sql(f"vx AS (SELECT *, {cell} FROM pts)", f"SELECT ix, iy, iz, {mean}, count(*) AS n FROM vx GROUP BY ix, iy, iz"),
    }


def _boxes() -> dict[str, str]:
    numbered = "nb AS (SELECT *, row_number() OVER (ORDER BY label)::INT AS seq FROM bx)"
    ends = ", ".join(f"({i}, {x}, {y}, {z})" for i, (x, y, z) in enumerate(B.CORNERS))
    lines = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(B.EDGES))
    spot = ", ".join(f"round(CASE WHEN e{c} = 1 THEN max{c} ELSE min{c} END, 6) AS {c}" for c in XYZ)
    meta = ", ".join(_xyz(k, v) for k, v in (("point_min_bound", "min{c}"), ("point_max_bound", "max{c}"), ("point_mean_center", "mean{c}"), ("point_extent", "extent{c}"), ("bbox_center", "centre{c}"), ("bbox_extent", "extent{c}")))
    corners = "[[minx, minz], [maxx, minz], [maxx, maxz], [minx, maxz]]"
    room = (
        "rm AS (SELECT label AS plan, round(minx, 3) AS minx, round(minz, 3) AS minz, round(maxx, 3) AS maxx, round(maxz, 3) AS maxz, "
        f"CASE WHEN label % 3 = 0 THEN {d(FQ.HALF_WALL)} ELSE 0 END AS off FROM bx)"
    )
    walls = (
        f"wl AS (SELECT plan, off, i AS wall_id, {corners}[i] AS a, {corners}[i % 4 + 1] AS b FROM rm, range(1, 5) t(i)), "
        "wd AS (SELECT plan, wall_id::INT AS wall_id, a[1] AS x0, a[2] AS y0, b[1] AS x1, b[2] AS y1, off, abs(b[1] - a[1]) + abs(b[2] - a[2]) + off AS width FROM wl)"
    )
    area = "((maxx - minx) * (maxz - minz))"
    return {
        "file_line_set_vertices": sql(boxes("bx", "pts"), numbered, f"ends(i, ex, ey, ez) AS (VALUES {ends})", f"SELECT 'boxes' AS object, 8 * (seq - 1)::BIGINT + i AS vid, {spot} FROM nb, ends"),
        "file_line_set_edges": sql(
            boxes("bx", "pts"), numbered, f"lines(i, a, b) AS (VALUES {lines})",
            "SELECT 'boxes' AS object, 12 * (seq - 1)::BIGINT + i AS eid, 8 * (seq - 1)::BIGINT + a AS v0, 8 * (seq - 1)::BIGINT + b AS v1, 1::DOUBLE AS r, 0::DOUBLE AS g, 0::DOUBLE AS b FROM nb, lines",
        ),
        "file_object_meta": sql(
            boxes("bx", "pts"), numbered, "nm AS (SELECT *, 'object_' || lpad(seq::VARCHAR, 3, '0') AS object_name FROM nb)",
            "SELECT object_name, object_name || '.ply' AS object_file, label AS source_cluster_label, n AS point_count, true AS has_colors, "
            f"'same_as_input_point_cloud' AS coordinate_system, {meta} FROM nm",
        ),
        "plan_walls": sql(boxes("bx", "pts"), room, walls, "SELECT plan, wall_id, round(width, 6) AS width_m, x0, y0, x1, y1, off = 0 AS width_ok, true AS area_ok, true AS angle_ok, true AS closed_ok FROM wd"),
        "plan_checks": sql(boxes("bx", "pts"), room, f"SELECT plan, round({area}, 6) AS shoelace_m2, off = 0 AS area_ok, true AS volume_ok, true AS corners_ok FROM rm"),
    }


def _meshes() -> dict[str, str]:
    whole = mesh(Q.MESH_SIZE).replace("label AS object", "0 AS object")
    top = d(float(Q.LEVELS - 1))
    shade = " || ' ' || ".join(f"format('{{:.6f}}', {c} / {top})" for c in ("qr", "qg", "qb"))
    place = " || ' ' || ".join(f"format('{{:.8f}}', {c})" for c in XYZ)
    counted = "SELECT line, count(*) AS n FROM (" + "{parts}" + ") GROUP BY line"
    mtl = ["SELECT 'newmtl ' || material AS line FROM mt"] + [f"SELECT '{k} ' || {shade} FROM mt" for k in ("Ka", "Kd")]
    mtl += [f"SELECT '{line}' FROM mt" for line in ("Ks 0.000000 0.000000 0.000000", "d 1.0", "illum 2")]
    obj = [
        "SELECT 'mtllib cloud.mtl' AS line",
        f"SELECT 'v ' || {place} FROM vertices",
        "SELECT 'f ' || (v0 + 1) || ' ' || (v1 + 1) || ' ' || (v2 + 1) FROM triangles",
        "SELECT 'usemtl ' || material FROM (SELECT material, lag(material) OVER (ORDER BY tid) AS last FROM triangles) WHERE last IS DISTINCT FROM material",
    ]
    spans = lambda source, p: (
        f"{p} AS (SELECT object, " + ", ".join(f"min({c}) AS {p}min{c}, max({c}) AS {p}max{c}, avg({c}) AS {p}mean{c}, max({c}) - min({c}) AS {p}extent{c}" for c in XYZ) + f" FROM {source} GROUP BY object)"
    )
    counts = (
        "ct AS (SELECT object, sum(n)::BIGINT AS points, count(*) AS voxels, count(DISTINCT material) AS materials, any_value(ox) AS ox, any_value(oy) AS oy, any_value(oz) AS oz FROM qvox GROUP BY object), "
        "fc AS (SELECT object, count(*) AS k FROM faces GROUP BY object)"
    )
    kinds = (("min_bound", "min"), ("max_bound", "max"), ("mean_center", "mean"), ("extent", "extent"))
    nested = [_xyz("voxel_grid_origin", "o{c}")] + [_xyz(f"{name}_{k}", p + a + "{c}") for name, p in (("original_point", "pm"), ("obj_mesh", "vm")) for k, a in kinds]
    return {
        "file_mesh_vertices": sql(whole, f"SELECT 'mesh' AS object, vid, {rounded(*XYZ)} FROM vertices"),
        "file_mesh_triangles": sql(whole, "SELECT 'mesh' AS object, tid, v0, v1, v2 FROM triangles"),
        "file_mtl": sql(whole, "mt AS (SELECT DISTINCT material, qr, qg, qb FROM triangles)", counted.format(parts=" UNION ALL ".join(mtl))),
        "file_obj": sql(whole, counted.format(parts=" UNION ALL ".join(obj))),
        "file_voxel_meta": sql(
            mesh(Q.MESH_SIZE), counts, spans("obj", "pm"), spans("vertices", "vm"),
            f"SELECT object, 'same_as_input_point_cloud' AS coordinate_system, false AS center_object, {d(Q.MESH_SIZE)} AS voxel_size, {Q.LEVELS} AS color_levels, points AS input_point_count, "
            "voxels AS voxel_count, 4 * k AS obj_vertex_count, 2 * k AS obj_triangle_count, materials AS material_count, true AS has_color, "
            f"{', '.join(nested)}, 'out/' || object || '.ply' AS source_ply, 'out/' || object || '_voxel.obj' AS output_obj, 'out/' || object || '_voxel.mtl' AS output_mtl "
            "FROM ct JOIN fc USING (object) JOIN pm USING (object) JOIN vm USING (object)",
        ),
    }


def _others(spatial: dict[str, str]) -> dict[str, str]:
    views = ", ".join(f"('{v}')" for v, _, _ in R.VIEWS)
    left = ", ".join(f"('{name.removesuffix('.ply')}')" for name in FQ.OLD_FILES if not name.startswith(("object_", "07_", "08_")))
    cleared = sum(name.startswith(("object_", "07_", "08_")) for name in FQ.OLD_FILES)
    paths = ", ".join(f"('{p}', '{r}')" for p, r in FQ.PATHS)
    return {
        "file_predictions": spatial["top_labels"],
        "file_images": f"WITH px AS ({spatial['render_pixels']}), vw(view) AS (VALUES {views}), ob AS (SELECT DISTINCT object FROM px) "
        "SELECT ob.object, vw.view, 1024 - count(px.px) FILTER (NOT (r = 255 AND g = 255 AND b = 255)) AS white FROM ob CROSS JOIN vw LEFT JOIN px ON px.object = ob.object AND px.view = vw.view GROUP BY 1, 2",
        "file_listing": f"SELECT name, 4::BIGINT AS length, {cleared} AS cleared FROM (VALUES {left}) t(name)",
        "file_paths": f"SELECT path, root, CASE WHEN path LIKE '/%' OR path LIKE '%://%' THEN path ELSE rtrim(root, '/') || '/' || path END AS resolved FROM (VALUES {paths}) t(path, root)",
    }


def oracle_sql(spatial: dict[str, str]) -> dict[str, str]:
    """SQL by query name; ``spatial`` has that of the operators whose rows go through files."""
    return _points() | _boxes() | _meshes() | _others(spatial)
