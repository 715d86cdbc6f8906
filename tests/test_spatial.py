"""Properties of the spatial operators against numpy and brute force."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.operators import boxes as B, cluster as C, detect as D, labels as L, mesh as M, neighbours as N, render as R, statistics as S, surface, transform as T, voxel as V
from pointloom.operators.graph import connected_components
from pointloom.plans import params
from pointloom.plans.numbering import number_rows
from pointloom.plans.skew import lookup_join


def cloud(spark, xyz, **more):
    pdf = pd.DataFrame({"point_id": range(len(xyz))} | {c: np.asarray(xyz, float)[:, i] for i, c in enumerate("xyz")} | more)
    return spark.createDataFrame(pdf).repartition(3)


def sequential_dbscan(xyz, eps, min_points):
    """The textbook algorithm, point by point."""
    n = len(xyz)
    near = [[j for j in range(n) if ((xyz[i] - xyz[j]) ** 2).sum() <= eps * eps] for i in range(n)]
    labels, current = [None] * n, -1
    for i in range(n):
        if labels[i] is not None:
            continue
        if len(near[i]) < min_points:
            labels[i] = -1
            continue
        current += 1
        labels[i], todo = current, list(near[i])
        while todo:
            j = todo.pop()
            if labels[j] in (None, -1):
                new = labels[j] is None
                labels[j] = current
                if new and len(near[j]) >= min_points:
                    todo += near[j]
    return labels


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(5)
    parts = [rng.normal(c, 0.05, (60, 3)) for c in ((0, 0, 0), (0.35, 0, 0), (0, 0.6, 0.2))]
    return np.concatenate([*parts, rng.uniform(-0.5, 1, (60, 3))])[rng.permutation(240)]


@pytest.mark.parametrize(("eps", "min_points"), [(0.05, 5), (0.1, 12), (0.02, 3), (0.3, 40)])
def test_dbscan_labels_are_those_of_the_sequential_algorithm(spark, blobs, eps, min_points):
    got = {r.point_id: r.label for r in C.dbscan(cloud(spark, blobs), eps, min_points).collect()}
    assert [got[i] for i in range(len(blobs))] == sequential_dbscan(blobs, eps, min_points)


def test_contested_border_points_and_copies(spark):
    left, right = [(-0.1, 0, 0)] * 5, [(0.1, 0, 0)] * 5
    xyz = np.array([(0, 0, 0), *right, *left], float)
    got = {r.point_id: r for r in C.dbscan(cloud(spark, xyz), 0.1, 6).collect()}
    assert not any(r.core for i, r in got.items() if i) or got[0].label == 0
    assert [got[i].label for i in range(11)] == sequential_dbscan(xyz, 0.1, 6)


def test_points_without_a_place_and_empty_clouds(spark):
    df = spark.createDataFrame([(0, None, 0.0, 0.0), (1, 1.0, 1.0, 1.0)], "point_id long, x double, y double, z double")
    assert {r.point_id: r.label for r in C.dbscan(df, 0.1, 1).collect()} == {0: -1, 1: 0}
    assert {r.point_id: r.n_near for r in N.radius_count(df, 0.1).collect()} == {0: None, 1: 1}
    empty = df.limit(0)
    assert C.dbscan(empty, 0.1, 1).count() == 0 and C.largest_fraction(C.dbscan(empty, 0.1, 1)) == 1.0
    assert V.downsample(empty, 0.1).count() == 0
    assert D.detect_objects(empty, params.DETECT_FINAL).boxes.count() == 0
    assert S.match_rate(empty.withColumn("distance", F.col("x")), (0.1,)).first().asDict() == {"mean": 0, "median": 0, "p90": 0, "p95": 0, "within_0": 0}


def test_tries_of_both_families():
    assert C.tries(params.DETECT_FINAL.clusters) == pytest.approx([0.04, 0.034, 0.03])
    assert C.tries(params.DETECT_V1.clusters) == pytest.approx([0.04, 0.034, 0.0289])
    assert C.tries(params.DETECT_V2.clusters) == pytest.approx([0.055, 0.04675, 0.0397375, 0.033776875, 0.02871034375])


@pytest.mark.parametrize("radius", [0.03, 0.1, 0.4])
def test_neighbour_joins_are_brute_force(spark, blobs, radius):
    a, b = blobs[:150], blobs[150:]
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    left, right = cloud(spark, a), cloud(spark, b, r=b[:, 0], g=b[:, 1], b=b[:, 2])
    counts = {r.point_id: r.n_near for r in N.radius_count(left, radius).collect()}
    own = np.sqrt(((a[:, None] - a[None]) ** 2).sum(axis=2))
    assert counts == {i: int((own[i] <= radius).sum()) for i in range(150)}
    kept = {r.point_id for r in N.remove_near(left, right, radius).collect()}
    assert kept == {i for i in range(150) if d[i].min() > radius}
    got = {r.point_id: r.distance for r in N.nearest(left, right, first_radius=radius).collect()}
    assert all(got[i] == pytest.approx(d[i].min()) for i in range(150))
    colours = {r.point_id: r.r for r in N.transfer_colours(left, right).collect()}
    assert all(colours[i] == pytest.approx(b[d[i].argmin(), 0]) for i in range(150))


def test_nearest_without_targets_and_far_away(spark):
    left = cloud(spark, [(0, 0, 0), (50, 50, 50)])
    assert [r.distance for r in N.nearest(left, left.limit(0)).collect()] == [None, None]
    far = cloud(spark, [(1000.0, 0, 0), (-3, 0, 0)])
    assert sorted(round(r.distance, 3) for r in N.nearest(left, far).collect()) == [3.0, 88.369]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 700)] + [(900, 900), (None, 3), (700, 701), (701, 700)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), "u", "v").collect()}
    assert got == {i: 0 for i in range(101)} | {i: 500 for i in range(500, 700)} | {900: 900, 700: 700, 701: 700}


def test_numbering_spans_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.hash("id") % 97).alias("k"), "id")
    rows = number_rows(df, ["g"], ["k", "id"], "nth").collect()
    for g in range(3):
        mine = sorted((r.k, r.id) for r in rows if r.g == g)
        assert {(r.k, r.id): r.nth for r in rows if r.g == g} == {v: i + 1 for i, v in enumerate(mine)}


def test_lookup_join_with_hot_and_null_keys(spark):
    rows = spark.createDataFrame([("a",)] * 50 + [(None,)] * 20 + [(f"k{i}",) for i in range(30)] + [("none",)], "k string")
    table = rows.where("k is null or k <> 'none'").groupBy("k").agg(F.count("*").alias("n"), F.concat_ws("", F.lit("v"), F.first("k")).alias("v"))
    got = lookup_join(rows, table, "k", "n", 101, slots=10)
    assert got.count() == 101 and got.columns == ["k", "v"]
    assert {(r.k, r.v) for r in got.collect()} == {(r.k, None if r.k == "none" else f"v{r.k or ''}") for r in rows.collect()}


def test_alignment_is_undone(spark, blobs):
    a = T.Alignment((0.3, -1, 2), ((0.36, 0.48, -0.8), (-0.8, 0.6, 0.0), (0.48, 0.64, 0.6)))
    moved = T.align(cloud(spark, blobs), a).toPandas().set_index("point_id").sort_index()[list("xyz")].to_numpy()
    assert np.allclose(moved, (blobs - a.centroid) @ np.array(a.rotation).T)
    back = T.unalign(T.align(cloud(spark, blobs), a), a).toPandas().set_index("point_id").sort_index()[list("xyz")].to_numpy()
    assert np.allclose(back, blobs, atol=1e-9)


def test_colours(spark):
    half = [0.5 / 7, 1.5 / 7, 2.5 / 7]
    df = spark.createDataFrame([(0, *half, 0), (1, -1.0, 2.0, None, -1), (2, 1.0, 0.0, 0.5, None)], "point_id long, r double, g double, b double, label int")
    got = {r.point_id: r for r in T.quantise_colours(df, 8).collect()}
    assert (got[0].qr, got[0].qg, got[0].qb, got[0].material) == (0, 2, 2, "mat_0_2_2")
    assert (got[1].qr, got[1].qg) == (0, 7)
    table = np.random.default_rng(0).random((5, 3))
    assert np.allclose(T.palette([0, 3, 4]), table[[0, 3, 4]])
    named = {r.point_id: r.r for r in T.colour_labels(df).collect()}
    assert named[0] == pytest.approx(table[0, 0]) and named[1] == named[2] == 0.2
    assert {r.r for r in T.colour_labels(df.where("point_id > 0")).collect()} == {0.5}
    assert [r.r for r in T.byte_colours(df.where("point_id = 2")).collect()] == [255]


def test_box_predicate_and_lines(spark):
    good = lambda e, p: B.good(spark.createDataFrame([(1, 999, *map(float, e))], "label int, n long, extentx double, extenty double, extentz double"), p).count() == 1
    p = params.BOXES
    assert good((0.5, 0.5, 0.5), p) and not good((0.07, 0.07, 0.07), p) and not good((0.5, 0.5, 0.01), p)
    assert good((1.0, 0.5, 0.01), p) and not good((1.0, 0.14, 0.03), p) and good((1.0, 0.2, 0.03), p)
    table = B.boxes(cloud(spark, [(0, 0, 0), (1, 2, 3)]).withColumn("label", F.lit(0))).withColumn("seq", F.lit(1))
    vertices, edges = (t.toPandas() for t in B.line_sets(table))
    corners = {r.vid: (r.x, r.y, r.z) for r in vertices.itertuples()}
    assert corners[4] == (1, 2, 3) and corners[7] == (1, 2, 0) and len(edges) == 12
    lengths = sorted(np.linalg.norm(np.subtract(corners[e.v0], corners[e.v1])) for e in edges.itertuples())
    assert lengths == [1] * 4 + [2] * 4 + [3] * 4


def test_merging_needs_near_centres(spark):
    """Boxes that touch are merged only if their centres lie in adjoining cells."""
    small = [(x, 0.0, 0.0) for x in np.linspace(0, 0.1, 90)] + [(x, 0.0, 0.0) for x in np.linspace(0.12, 0.22, 90)]
    far = [(x, 5.0, 0.0) for x in np.linspace(0, 2, 90)] + [(x, 5.0, 0.0) for x in np.linspace(2.01, 4, 90)]
    tiny = [(9.0, 9.0, 9.0)] * 5
    labels = [0] * 90 + [1] * 90 + [2] * 90 + [3] * 90 + [4] * 5
    df = cloud(spark, small + far + tiny, label=labels)
    got = {r.point_id: r.label for r in C.merge_clusters(df, params.Merge()).collect()}
    assert [got[i] for i in (0, 90, 180, 270, 360)] == [1, 1, 2, 3, 0]


def test_splitting_at_a_bridge(spark):
    rng = np.random.default_rng(8)
    blob = lambda c: rng.normal(c, 0.03, (400, 3))
    bridge = np.stack([np.linspace(0.1, 0.9, 60), np.zeros(60), np.zeros(60)], axis=1)
    xyz = np.concatenate([blob((0, 0, 0)), blob((1, 0, 0)), bridge])
    p = params.Split(500, 0.5, 9.0, 0.10, 60, 300, 0.2, 0.65, 0.02, 20, 80)
    df = cloud(spark, xyz, label=[0] * len(xyz))
    got = C.split_clusters(df, p, 0.06).toPandas().set_index("point_id").sort_index()
    assert set(got.part[:400].dropna()) == {0} and set(got.part[400:800].dropna()) == {1}
    assert got.part[800:].isna().mean() > 0.7 and got.removed[810:850].all()
    whole = C.split_clusters(df, params.Split(), 0.06).toPandas()
    assert (whole.part == 0).all() and not whole.removed.any()


def test_structure_removal(spark):
    rng = np.random.default_rng(9)
    floor = np.stack([rng.uniform(0, 3, 4000), np.zeros(4000), rng.uniform(0, 3, 4000)], axis=1)
    box = rng.uniform((1, 0.3, 1), (1.4, 0.9, 1.4), (6000, 3))
    balloon = rng.uniform((2.5, 2.0, 2.5), (2.7, 2.2, 2.7), (700, 3))
    got = D.remove_structure(cloud(spark, np.concatenate([floor, box, balloon])), cloud(spark, floor), params.Structure(outlier_points=20))
    left = got.objects.toPandas()
    assert abs(got.floor) < 0.02 and left.y.max() < 1.0 and left.y.min() > 0.08 and len(left) > 1000
    assert got.without_outliers.where("y > 1.5").count() > 100


def cube_mesh(spark, copies=1):
    points = cloud(spark, [(0, 0, 0), (0, 0, 0.01)] * copies, r=[0.1, 0.9] * copies, g=[0.5] * 2 * copies, b=[0.5] * 2 * copies).withColumn("object", F.lit("o"))
    return V.surface_mesh(points, 0.01, 8, ["object"])


def test_voxel_mesh_and_its_clean_up(spark):
    mesh = M.Mesh(*cube_mesh(spark))
    assert mesh.vertices.count() == 40 and mesh.triangles.count() == 20
    welded = M.remove_duplicate_vertices(M.Mesh(mesh.vertices.withColumns({c: F.round(c, 6) for c in "xyz"}), mesh.triangles))
    assert welded.vertices.count() == 12
    assert M.component_sizes(welded).collect()[0].n == 20
    clean = M.reindex(M.clean(welded))
    assert [r.vid for r in clean.vertices.orderBy("vid").collect()] == list(range(12))
    normals = M.triangle_normals(clean).toPandas()
    centre = np.array([0, 0, 0.005])
    places = clean.vertices.toPandas().set_index("vid")[list("xyz")]
    for t in normals.itertuples():
        outward = places.loc[[t.v0, t.v1, t.v2]].to_numpy().mean(axis=0) - centre
        assert outward @ (t.nx, t.ny, t.nz) > 0
    smooth = M.taubin(clean, 3).vertices.toPandas()
    assert np.isfinite(smooth[list("xyz")]).all().all()
    fewer = surface.decimate(clean, 10)
    assert fewer.triangles.count() <= 10
    assert fewer.triangles.join(fewer.vertices, (fewer.triangles.v0 == fewer.vertices.vid)).count() == fewer.triangles.count()


def test_non_manifold_edges_lose_their_smallest_triangles(spark):
    vertices = spark.createDataFrame([("o", i, *map(float, p)) for i, p in enumerate([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 2), (0, -3, 0)])], "object string, vid long, x double, y double, z double")
    triangles = spark.createDataFrame([("o", 0, 0, 1, 2), ("o", 1, 0, 1, 3), ("o", 2, 0, 1, 4)], "object string, tid long, v0 long, v1 long, v2 long")
    got = M.clean(M.Mesh(vertices, triangles))
    assert sorted(r.tid for r in got.triangles.collect()) == [1, 2] and sorted(r.vid for r in got.vertices.collect()) == [0, 1, 3, 4]


def test_refining_and_reconstruction(spark):
    rng = np.random.default_rng(10)
    g = np.stack(np.meshgrid(np.arange(12) * 0.02, np.arange(12) * 0.02), axis=-1).reshape(-1, 2)
    vertices = spark.createDataFrame([("o", i, float(x), float(y), 0.0) for i, (x, y) in enumerate(g)] + [("o", 200, 5.0, 5.0, 5.0)], "object string, vid long, x double, y double, z double")
    faces = [(i * 12 + j, i * 12 + j + 1, (i + 1) * 12 + j) for i in range(11) for j in range(11)] + [(i * 12 + j + 1, (i + 1) * 12 + j + 1, (i + 1) * 12 + j) for i in range(11) for j in range(11)]
    triangles = spark.createDataFrame([("o", k, *f) for k, f in enumerate(faces)] + [("o", 999, 0, 1, 200)], "object string, tid long, v0 long, v1 long, v2 long")
    source = cloud(spark, np.concatenate([np.column_stack([g, np.zeros(len(g))]) + rng.normal(0, 0.001, (len(g), 3))]), r=[0.2] * 144, g=[0.4] * 144, b=[0.6] * 144)
    mesh = M.refine(M.Mesh(vertices, triangles), source, params.REFINE)
    got = mesh.vertices.toPandas()
    assert mesh.triangles.count() == 242 and len(got) == 144 and (got.g == 0.4).all() and np.allclose(np.abs(got.nz), 1, atol=0.2)
    solver = lambda points, depth, scale: M.Mesh(vertices.withColumn("density", F.lit(1.0)), triangles)
    few = replace(params.MESH, min_points=100, crop_margin=0.01)
    made = surface.reconstruct(source.withColumn("object", F.lit("o")), few, solver)
    assert made.triangles.count() == 242 and {round(r.b, 6) for r in made.vertices.collect()} == {0.6}
    assert surface.reconstruct(source.withColumn("object", F.lit("o")), params.MESH, solver).triangles.count() == 0
    cropped = M.crop_mesh(M.Mesh(vertices, triangles), (0, 0, 0), (0.1, 0.3, 0.1), 0.005)
    assert cropped.vertices.count() == 72 and cropped.triangles.count() == 110
    assert M.combine([mesh, M.Mesh(mesh.vertices.withColumn("object", F.lit("p")), mesh.triangles.withColumn("object", F.lit("p")))]).vertices.count() == 144


def test_normals_point_one_way(spark):
    rng = np.random.default_rng(11)
    xy = rng.uniform(0, 1, (150, 2))
    plane = np.column_stack([xy, 0.2 * xy[:, 0]])
    df = surface.orient_normals(surface.estimate_normals(cloud(spark, plane).withColumn("object", F.lit("o")), 0.3, 30), 12)
    n = df.toPandas()[["nx", "ny", "nz"]].to_numpy()
    want = np.array([-0.2, 0, 1]) / np.sqrt(1.04)
    assert np.allclose(n, want, atol=1e-6)


def test_oriented_box_of_a_turned_bar(spark):
    rng = np.random.default_rng(12)
    bar = rng.uniform((-1, -0.2, -0.05), (1, 0.2, 0.05), (4000, 3))
    turn = np.array(((0.36, 0.48, -0.8), (-0.8, 0.6, 0.0), (0.48, 0.64, 0.6)))
    got = B.oriented_boxes(cloud(spark, bar @ turn.T + 3, label=[0] * 4000)).first()
    assert np.allclose(got.extent, (2, 0.4, 0.1), atol=0.03) and np.allclose(got.centre, 3, atol=0.05)


def test_rendering(spark):
    df = cloud(spark, [(0, 0, 0), (0, 0, 1), (1, 0, 0)], r=[10, 200, 30], g=[0] * 3, b=[0] * 3).withColumn("object", F.lit("o"))
    front = R.rotate_views(df, R.VIEWS[:1])
    pixels = R.rasterise(front, size=32, radius=1)
    nearest = {r.r for r in pixels.collect()}
    assert nearest == {200, 30} or nearest == {10, 200, 30}
    png = R.images(pixels, size=32).first().png
    assert png.startswith(b"\x89PNG") and len(R.disc(2)) == 21


def test_top_labels_break_ties_by_position(spark):
    table = L.prompts(spark)
    rows = [("o", v, i, 0.0) for v in ("a", "b") for i in range(48)]
    scores = L.label_scores(L.softmax(spark.createDataFrame(rows, "object string, view string, prompt_id int, logit double")), table)
    got = L.top_labels(scores).first()
    assert (got.top1_label, got.top2_label, got.top3_label) == ("bed", "desk", "chair") and got.top1_score == pytest.approx(1 / 12)
    assert table.where("prompt = 'a rendered view of a trash bin'").count() == 1
    model = lambda png, prompts: [float(len(png))] * len(prompts)
    images = spark.createDataFrame([("o", "front", b"123")], "object string, view string, png binary")
    assert L.predict(images, table, model).count() == 48


def test_components_with_a_hub_of_most_edges(spark, monkeypatch):
    """As if the edges were too many for a task: the hub's are spread over several, and the result is the same."""
    from pointloom.operators import graph

    edges = spark.createDataFrame([(5, i) for i in range(100, 400)] + [(i, i + 1) for i in range(1000, 1040)] + [(399, 7), (2000, 2000)], "a long, b long")
    rows = lambda: sorted(tuple(r) for r in graph.connected_components(edges, "a", "b").collect())
    plain = rows()
    monkeypatch.setattr(graph, "TASK_EDGES", 0)
    assert rows() == plain
    assert {c for _, c in plain} == {5, 1000, 2000}


SF = "/root/testdata/sf0.001"


def _cloud(spark):
    from pointloom.plans import queries as Q

    return Q, Q.cloud(spark, SF).cache()


def _nearest_axes(places, radius, most):
    """Least principal axes of the nearest points, plainly."""
    out = []
    for p in places:
        d = ((places - p) ** 2).sum(axis=1)
        order = np.lexsort((places[:, 2], places[:, 1], places[:, 0], d))
        near = places[[i for i in order if d[i] <= radius * radius][:most]]
        if len(near) < 3:
            out.append(((0.0, 0.0, 1.0), 1.0))
            continue
        values, vectors = np.linalg.eigh(np.cov(near.T, bias=True))
        out.append((vectors[:, 0], (values[1] - values[0]) / values[2]))
    return out


def test_estimated_normals_by_brute_force(spark):
    Q, points = _cloud(spark)
    rows = {r.point_id: r for r in points.collect()}
    ids = sorted(rows)
    want = _nearest_axes(np.array([[rows[i].x, rows[i].y, rows[i].z] for i in ids]), 0.2, 20)
    got = {r.point_id: np.array([r.nx, r.ny, r.nz]) for r in Q.estimate_normals(points).collect()}
    for i, (axis, gap) in zip(ids, want, strict=True):
        if gap > 1e-3:
            assert abs(abs(got[i] @ axis) - 1) < 1e-3
            assert got[i][np.abs(got[i]).argmax()] > 0


def test_normals_of_a_dense_cloud_without_all_its_pairs(spark, monkeypatch):
    """A dense ball, points around it, far ones and copies: nearest places are exact, and few pairs are made."""
    rng = np.random.default_rng(17)
    at = np.concatenate([rng.normal(0, 0.002, (1500, 3)), rng.normal(0, 0.15, (500, 3)), [(3, 3, 3), (3.1, 3, 3), (-9, 0, 0)]])
    at = np.concatenate([at, at[:40], at[:40]])
    pairs, near_places = [], N.near_places

    def counted(*args, **named):
        pairs.append(near_places(*args, **named).count())
        return near_places(*args, **named)

    for module in (N, surface):
        monkeypatch.setattr(module, "near_places", counted, raising=False)
    got = surface.estimate_normals(cloud(spark, at), 0.2, 20).orderBy("point_id").toPandas()[["nx", "ny", "nz"]].to_numpy()
    assert sum(pairs) < 200 * len(at)
    places = np.unique(at, axis=0)
    for p, n in zip(at[::7], got[::7], strict=True):
        d = ((places - p) ** 2).sum(axis=1)
        near = places[np.argsort(d, kind="stable")[:20]]
        near = near[((near - p) ** 2).sum(axis=1) <= 0.2 * 0.2]
        if len(near) < 3:
            assert tuple(n) == (0, 0, 1)
            continue
        values, axes = np.linalg.eigh(np.cov(near.T, bias=True))
        if values[1] - values[0] > 0.02 * values[2]:
            assert abs(abs(axes[:, 0] @ n) - 1) < 1e-6
    assert surface.estimate_normals(cloud(spark, at).limit(0), 0.2, 20).count() == 0


@pytest.mark.parametrize("kind", ["spread", "grid", "copies"])
def test_neighbours_of_an_object_are_brute_force(monkeypatch, kind):
    """Ties go by position, a place of many copies counts as its points do, and few distances are taken."""
    rng = np.random.default_rng(18)
    at = {"spread": rng.normal(0, 1, (3000, 3)), "grid": rng.integers(0, 7, (2000, 3)).astype(float), "copies": np.concatenate([np.zeros((900, 3)), rng.normal(0, 1, (900, 3))])}[kind]
    taken, squared = [], surface._squared
    monkeypatch.setattr(surface, "_squared", lambda a, b: taken.append(len(a) * len(b)) or squared(a, b))
    got = surface._near(at, 8)
    assert sum(taken) < 0.7 * len(at) ** 2
    assert (got == np.argsort(((at[:, None] - at[None]) ** 2).sum(axis=2), axis=1, kind="stable")[:, 1:9]).all()


def test_solver_counts_near_its_vertices_only(spark, monkeypatch):
    Q, points = _cloud(spark)
    asked, near_places = set(), N.near_places

    def noted(left, *args, **named):
        asked.update(tuple(r) for r in left.select("lx", "ly", "lz").collect())
        return near_places(left, *args, **named)

    monkeypatch.setattr(N, "near_places", noted)
    got = Q.voxel_solver(Q._whole(points), 0, 1.0).vertices.toPandas()
    at = np.concatenate([points.toPandas()[["x", "y", "z"]].to_numpy(), got[["x", "y", "z"]].to_numpy()])
    assert asked and not asked & {(r.x, r.y, r.z) for r in points.collect()}
    d2 = ((got[["x", "y", "z"]].to_numpy()[:, None] - at[None]) ** 2).sum(axis=2)
    lo, hi = ((d2 <= (Q.MESH_SIZE + s) ** 2).sum(axis=1) for s in (-1e-5, 1e-5))
    assert ((lo <= got.density) & (got.density <= hi)).all()


def test_oriented_normals_keep_their_axes(spark):
    Q, points = _cloud(spark)
    plain = {r.point_id: np.array([r.nx, r.ny, r.nz]) for r in Q.estimate_normals(points).collect()}
    for r in Q.orient_normals(points).collect():
        assert abs(abs(plain[r.point_id] @ np.array([r.nx, r.ny, r.nz])) - 1) < 1e-2


def test_decimation_stays_near_the_surface(spark):
    Q, points = _cloud(spark)
    before = Q._welded(points)
    sizes = {r.object: r["count"] for r in before.triangles.groupBy("object").count().collect()}
    corners = before.vertices.toPandas()
    rows = Q.decimate_mesh(points).toPandas()
    for name, mesh in rows.groupby("object"):
        assert len(mesh) <= max(100, 1) or sizes[name] <= 100
        own = corners[corners.object == name][["x", "y", "z"]].to_numpy()
        for k in range(3):
            p = mesh[[f"x{k}", f"y{k}", f"z{k}"]].to_numpy()
            assert np.sqrt(((p[:, None] - own[None]) ** 2).sum(axis=2).min(axis=1)).max() < 1.5 * Q.MESH_SIZE
        assert (own.min(axis=0) - Q.MESH_SIZE <= mesh[["x0", "y0", "z0"]].to_numpy().min(axis=0)).all()
    assert len(set(rows.object)) == len(sizes)


def test_edges_have_two_triangles_at_most(spark):
    """By plain rounds: each crowded edge gives up its smallest triangle until none is crowded."""
    Q, points = _cloud(spark)
    kept, seen = {(r.object, r.tid) for r in Q.non_manifold(points).collect()}, {}
    mesh, capture = Q._welded(points), M.remove_non_manifold
    try:
        M.remove_non_manifold = lambda m: seen.setdefault("mesh", m)
        Q.non_manifold(points)
    finally:
        M.remove_non_manifold = capture
    places = {(r.object, r.vid): np.array([r.x, r.y, r.z]) for r in mesh.vertices.collect()}
    live = {(r.object, r.tid): (r.v0, r.v1, r.v2) for r in seen["mesh"].triangles.collect()}
    area = {k: np.linalg.norm(np.cross(places[k[0], v[1]] - places[k[0], v[0]], places[k[0], v[2]] - places[k[0], v[0]])) / 2 for k, v in live.items()}
    start = len(live)
    while True:
        edges = {}
        for (o, t), v in live.items():
            for a, b in ((0, 1), (1, 2), (2, 0)):
                edges.setdefault((o, min(v[a], v[b]), max(v[a], v[b])), []).append((round(area[o, t], 12), t))
        gone = {(e[0], min(ts)[1]) for e, ts in edges.items() if len(ts) > 2}
        if not gone:
            break
        live = {k: v for k, v in live.items() if k not in gone}
    assert len(live) < start and {k for k in live} == kept


def test_smoothing_by_all_steps(spark):
    Q, points = _cloud(spark)
    mesh = Q._welded(points.where("label < 2"))
    places = {(r.object, r.vid): np.array([r.x, r.y, r.z]) for r in mesh.vertices.collect()}
    links = {k: set() for k in places}
    for r in mesh.triangles.collect():
        for a, b in ((r.v0, r.v1), (r.v1, r.v2), (r.v2, r.v0)):
            links[r.object, a].add((r.object, b))
            links[r.object, b].add((r.object, a))
    for _ in range(35):
        for factor in (0.5, -0.53):
            new = {}
            for k, p in places.items():
                w = {j: 1 / (np.linalg.norm(places[j] - p) + 1e-12) for j in links[k]}
                new[k] = p + factor * (sum(v * places[j] for j, v in w.items()) / sum(w.values()) - p) if w else p
            places = new
    for r in Q.taubin_smooth(points).collect():
        assert np.allclose(places[r.object, r.vid], [r.x, r.y, r.z], atol=1e-5)


def test_refined_and_reconstructed_meshes(spark):
    """Vertices stay near the cloud, have unit normals, and the colours of the nearest point."""
    Q, points = _cloud(spark)
    cloud = points.toPandas()
    at = cloud[["x", "y", "z"]].to_numpy()
    for query, far in ((Q.refine_mesh, Q.REFINE.final_far), (Q.cloud_to_mesh, 2 * Q.MESH_SIZE)):
        got = query(points).toPandas()
        assert len(got) > 0 and sorted(got.vid) == list(range(len(got))) or query is Q.cloud_to_mesh and len(got) > 0
        d = np.sqrt(((got[["x", "y", "z"]].to_numpy()[:, None] - at[None]) ** 2).sum(axis=2))
        assert d.min(axis=1).max() <= far + 1e-6
        size = np.sqrt((got[["nx", "ny", "nz"]].to_numpy() ** 2).sum(axis=1))
        assert ((np.abs(size - 1) < 1e-4) | (size == 0)).all()
        near = cloud[["r", "g", "b"]].to_numpy()[d.argmin(axis=1)]
        assert np.isclose(near, got[["r", "g", "b"]].to_numpy(), atol=1e-5).all(axis=1).mean() > 0.99


@pytest.mark.parametrize("spread", [1.0, 1e-9, 1e9])
def test_percentiles_over_several_tasks(spark, monkeypatch, spread):
    """As if groups were too large for one task; one group holds most rows, and most of its values are one."""
    rng = np.random.default_rng(3)
    rows = [(0, float(v)) for v in np.where(rng.random(3000) < 0.7, 0.5, rng.normal(0, spread, 3000))]
    rows += [(1, float(v)) for v in rng.normal(5, 1, 17)] + [(2, 1.25), (3, None), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    shares = {"lo": 0.01, "mid": 0.5, "hi": 0.93, "top": 1.0}
    plain = {r.g: r[1:] for r in S.percentiles(df, "v", shares, ["g"]).collect()}
    monkeypatch.setattr(S, "TASK_VALUES", 0)
    monkeypatch.setattr(S, "BINS", 16)
    spreads = {r.g: r[1:] for r in S.percentiles(df, "v", shares, ["g"]).collect()}
    assert plain.keys() == spreads.keys() == {0, 1, 2, None}
    for g, values in plain.items():
        assert np.allclose(values, spreads[g], rtol=1e-12)
        assert np.allclose(values, np.quantile([v for k, v in rows if k == g], list(shares.values())), rtol=1e-12)
    assert S.percentiles(df.where("v > 1e99"), "v", shares).first().mid is None


def test_ranks_over_several_tasks(spark, monkeypatch):
    from pointloom.plans import numbering

    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k long")
    monkeypatch.setattr(numbering, "TASK_ROWS", 0)
    assert sorted(tuple(r) for r in numbering.ranks(df, ["k"], "nth").collect()) == [(i, i + 1) for i in range(101)]


def test_crowded_places_are_those_with_enough_near(spark):
    """Also where a cell alone has enough points, and where copies count."""
    rng = np.random.default_rng(4)
    places = np.concatenate([rng.normal(0, 0.02, (200, 3)), rng.random((200, 3)), np.repeat(rng.random((3, 3)), 6, axis=0)])
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)], "point_id long, x double, y double, z double")
    for radius, least in ((0.05, 5), (0.1, 12), (0.02, 1)):
        near = (((places[:, None] - places[None]) ** 2).sum(axis=2) <= radius * radius).sum(axis=1) >= least
        got = {r.point_id: r.dense for r in N.has_near(points, radius, least).collect()}
        assert [got[i] for i in range(len(places))] == near.tolist()


def test_clusters_do_not_depend_on_stored_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.random((300, 3)))], "point_id long, x double, y double, z double")
    labels = lambda: sorted((r.point_id, r.core, r.label) for r in C.dbscan_auto(points, params.DbscanAuto(0.16, 6, 0.2, 0.9, 2, 0.1))[0].collect())
    plain = labels()
    monkeypatch.setattr(C, "with_pairs", lambda places, radius, keys: places)
    assert labels() == plain


@pytest.mark.parametrize("top", [64, 1])
def test_nearest_down_the_pyramid(spark, monkeypatch, top):
    """As if no ring had found anything: places inside, near and far, among clustered targets, ties included."""
    rng = np.random.default_rng(12)
    goal = np.concatenate([rng.normal(0, 0.1, (300, 3)), rng.normal(5, 0.5, (100, 3)), [[-3.0, 0.0, 0.0], [3.0, 0.0, 0.0]]])
    places = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(0, 60, (40, 3)), goal[:5], [[0.0, 500.0, 0.0]]])
    frame = lambda rows, first: spark.createDataFrame([(first + i, *map(float, p)) for i, p in enumerate(rows)], "point_id long, x double, y double, z double")
    monkeypatch.setattr(N, "RINGS", 0)
    monkeypatch.setattr(N, "TOP_CELLS", max(top, 8))
    target = frame(goal, 1000).withColumn("name", F.col("point_id"))
    d = np.sqrt(((places[:, None] - goal[None]) ** 2).sum(axis=2))
    for r in N.nearest(frame(places, 0), target, ["name"]).collect():
        assert r.distance == pytest.approx(d[r.point_id].min(), rel=1e-9, abs=1e-12)
        assert d[r.point_id, r.name - 1000] == pytest.approx(d[r.point_id].min(), rel=1e-9, abs=1e-12)
