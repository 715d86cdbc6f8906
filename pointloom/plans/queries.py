"""The registered queries of the spatial operators.

The ``embeddings`` table serves as a point cloud: its first three dimensions are the
place, the next three the colour, and ``label`` the object or the scene.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pointloom.functions import geometry as G
from pointloom.operators import boxes as B, cluster as C, detect as D, labels as L, mesh as M, neighbours as N, plan as P, render as R, statistics as S, surface, transform as T, voxel as V
from pointloom.operators.graph import connected_components
from pointloom.plans.lineage import cut
from pointloom.plans.numbering import number_rows
from pointloom.plans.scalars import one_row
from pointloom.plans.params import BoxFilter, DbscanAuto, Detect, Merge, Reconstruct, Refine, Split, Structure

#: Parameters of the queries, fitted to the extent of the table's cloud (about 0.9 in each direction).
SIZE, MESH_SIZE, LEVELS = 0.1, 0.2, 8
RADIUS, EPS, MIN_POINTS = 0.1, 0.08, 12
ALIGNMENT = T.Alignment((0.1, -0.2, 0.3), ((0.36, 0.48, -0.8), (-0.8, 0.6, 0.0), (0.48, 0.64, 0.6)))
AUTO = DbscanAuto(0.12, 12, 0.3, 0.8, 4, 0.05)
AUTO_FLOOR = DbscanAuto(0.12, 12, 0.3, 0.6, 6, 0.05, True)
BOXES = BoxFilter(5, 0.2, 0.1, 0.05, 3.0, 0.2)
OBJECT_BOXES = BoxFilter(15, 0.05, 0.02, 0.02, 12.0, 0.05)
MERGE = Merge(0.15, 5)
SPLIT = Split(20, 0.3, 0.05, 0.1, 12, 8, 0.2, 0.75, 0.03, 5, 5)
STRUCTURE = Structure(voxel=0.02, remove_radius=0.08, outlier_points=1, outlier_radius=0.1, float_eps=0.08, float_min_points=5, float_gap=0.25, float_max_points=40, float_max_extent=0.25)
SAMPLE, EDGE, AREA = 0.13, 0.29, 0.0201
DECIMALS = 6


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, x, y, z, r, g, b, label; vectors that are null or too short have no place and are left out."""
    e = F.col("embedding")
    at = lambda i: F.get(e, F.lit(i)).cast("double")
    shade = lambda i: F.least(F.greatest(at(i) + 0.5, F.lit(0.0)), F.lit(1.0))
    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("point_id"), *(at(i).alias(c) for i, c in enumerate(G.XYZ)), *(shade(i + 3).alias(c) for i, c in enumerate(G.RGB)), "label"
    )
    return points.dropna(subset=list(G.XYZ))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DECIMALS) for c in names})


def _objects(points: DataFrame) -> DataFrame:
    return points.withColumnRenamed("label", "object")


def _halves(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two clouds: the points of the first five labels, and those of the others."""
    return points.where("label < 5"), points.where("label >= 5")


def _mesh(points: DataFrame) -> M.Mesh:
    return M.Mesh(*(cut(t) for t in V.surface_mesh(_objects(points), MESH_SIZE, LEVELS)))


def _welded(points: DataFrame) -> M.Mesh:
    """The voxel mesh with its repeated vertices joined."""
    mesh = _mesh(points)
    return M.Mesh(*(cut(t) for t in M.remove_duplicate_vertices(M.Mesh(_rounded(mesh.vertices, *G.XYZ), mesh.triangles))))


def voxel_downsample(points: DataFrame) -> DataFrame:
    return _rounded(V.downsample(points, SIZE), *G.XYZ, *G.RGB)


def voxel_grid(points: DataFrame) -> DataFrame:
    cells = V.grid(_objects(points), SIZE, ["object"])
    return _rounded(cells, *G.RGB).select("object", *V.CELL, *G.RGB, "n")


def exposed_faces(points: DataFrame) -> DataFrame:
    return V.exposed_faces(V.grid(_objects(points), SIZE, ["object"]), ["object"])


def voxel_mesh_counts(points: DataFrame) -> DataFrame:
    return V.mesh_counts(_objects(points), SIZE, LEVELS)


def voxel_mesh_vertices(points: DataFrame) -> DataFrame:
    return _rounded(V.surface_mesh(_objects(points), SIZE, LEVELS)[0], *G.XYZ)


def voxel_mesh_triangles(points: DataFrame) -> DataFrame:
    return V.surface_mesh(_objects(points), SIZE, LEVELS)[1]


def centred_mesh(points: DataFrame) -> DataFrame:
    return _rounded(V.centred(_mesh(points).vertices), *G.XYZ)


def color_quantize(points: DataFrame) -> DataFrame:
    return T.quantise_colours(points, LEVELS).select("point_id", "qr", "qg", "qb", "material")


def rigid_align(points: DataFrame) -> DataFrame:
    named = points.withColumns(dict(zip(G.NORMAL, G.columns(G.RGB), strict=True)))
    return _rounded(T.align(named, ALIGNMENT), *G.XYZ, *G.NORMAL).select("point_id", *G.XYZ, *G.NORMAL)


def rigid_roundtrip(points: DataFrame) -> DataFrame:
    return _rounded(T.unalign(T.align(points, ALIGNMENT), ALIGNMENT), *G.XYZ).select("point_id", *G.XYZ)


def cluster_aabb(points: DataFrame) -> DataFrame:
    kept = ("n", *B.LOW, *B.HIGH, *B.EXTENT, *B.CENTRE, "volume", "meanx", "meany", "meanz")
    return _rounded(B.boxes(points), *kept[1:]).select("label", *kept)


def _voxel_boxes(points: DataFrame) -> DataFrame:
    """Boxes of the points of each cell of a coarse grid, as many boxes of different shapes."""
    cells = V.with_cells(points.drop("label"), 0.3).withColumn("label", F.concat_ws("_", *V.CELL))
    return B.boxes(cells)


def bbox_filter(points: DataFrame) -> DataFrame:
    return B.good(_voxel_boxes(points), BOXES).select("label", "n")


def big_clusters(points: DataFrame) -> DataFrame:
    return _voxel_boxes(points).select("label", B.is_big(Split(12, 0.28, 0.015)).alias("is_big"))


def expand_boxes(points: DataFrame) -> DataFrame:
    return _rounded(B.expand(B.boxes(points), 0.05), *B.LOW, *B.HIGH, *B.EXTENT).select("label", *B.LOW, *B.HIGH, *B.EXTENT)


def crop_points(points: DataFrame) -> DataFrame:
    return T.crop(points, (-0.1, -0.1, -0.1), (0.1, 0.15, 0.2), 0.03).select("point_id")


def radius_count(points: DataFrame) -> DataFrame:
    return N.radius_count(points, RADIUS).select("point_id", "n_near")


def radius_outlier(points: DataFrame) -> DataFrame:
    return N.radius_outliers(points, RADIUS, 10).select("point_id", "keep")


def outlier_counts(points: DataFrame) -> DataFrame:
    return S.kept_and_removed(N.radius_outliers(points, RADIUS, 10), "keep", ["label"])


def bridge_cut(points: DataFrame) -> DataFrame:
    return C.cut_bridges(points, SPLIT, ["label"]).select("point_id", "bridge")


def near_distance(points: DataFrame) -> DataFrame:
    left, right = _halves(points)
    return _rounded(N.near_distance(left, right, RADIUS), "distance").select("point_id", "distance")


def nn_distance(points: DataFrame) -> DataFrame:
    left, right = _halves(points)
    return _rounded(N.nearest(left, right), "distance").select("point_id", "distance")


def structure_anti_join(points: DataFrame) -> DataFrame:
    return N.remove_near(*_halves(points), RADIUS).select("point_id")


def removed_points(points: DataFrame) -> DataFrame:
    left, right = _halves(points)
    return T.difference(left, N.remove_near(left, right, RADIUS)).select("point_id")


def match_rate(points: DataFrame) -> DataFrame:
    rate = S.match_rate(N.nearest(*_halves(points)), (0.05, 0.08, 0.1))
    return _rounded(rate, *rate.columns)


def color_transfer(points: DataFrame) -> DataFrame:
    left, right = _halves(points)
    return _rounded(N.transfer_colours(left, right), *G.RGB).select("point_id", *G.RGB)


def floor_percentile(points: DataFrame) -> DataFrame:
    return _rounded(S.percentiles(points, "y", {"low": 0.01, "high": 0.99}, ["label"]), "low", "high")


def floating_clusters(points: DataFrame) -> DataFrame:
    return C.floating_clusters(points.drop("label"), STRUCTURE, C.floor_height(points, STRUCTURE)).select("point_id", "label", "floating")


def dbscan_labels(points: DataFrame) -> DataFrame:
    return C.dbscan(points.drop("label"), EPS, MIN_POINTS).select("point_id", "core", "cluster", "label")


def dbscan_groups(points: DataFrame) -> DataFrame:
    return C.dbscan(_objects(points), 0.15, 5, ["object"]).select("point_id", "core", "cluster", "label")


def dbscan_auto(points: DataFrame) -> DataFrame:
    return C.dbscan_auto(points.drop("label"), AUTO)[0].select("point_id", "label")


def dbscan_auto_floor(points: DataFrame) -> DataFrame:
    return C.dbscan_auto(points.drop("label"), AUTO_FLOOR)[0].select("point_id", "label")


def cluster_fraction(points: DataFrame) -> DataFrame:
    labelled = cut(C.dbscan(points.drop("label"), EPS, MIN_POINTS))
    clusters = labelled.agg(F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("clusters"))
    return clusters.select(F.round(F.lit(C.largest_fraction(labelled)), DECIMALS).alias("fraction"), "clusters")


def merge_clusters(points: DataFrame) -> DataFrame:
    labelled = cut(C.dbscan(points.drop("label"), 0.06, 5))
    return C.merge_clusters(labelled, MERGE).select("point_id", "label")


def split_clusters(points: DataFrame) -> DataFrame:
    labelled = cut(C.dbscan(points.drop("label"), 0.12, 5).drop("core", "cluster"))
    return C.split_clusters(labelled, SPLIT, 0.12).select("point_id", "label", "part", "removed")


def detect_objects(points: DataFrame) -> DataFrame:
    got = D.detect_objects(points.drop("label"), Detect(AUTO, OBJECT_BOXES)).boxes
    return _rounded(got, *B.LOW, *B.HIGH).select("object_name", "seq", "label", "n", *B.LOW, *B.HIGH)


def detect_merged(points: DataFrame) -> DataFrame:
    return D.detect_objects(points.drop("label"), Detect(DbscanAuto(0.06, 5, 1.0, 0.8, 0, 0.05), OBJECT_BOXES, MERGE)).points.select("point_id", "label")


def detect_split(points: DataFrame) -> DataFrame:
    return D.detect_objects(points.drop("label"), Detect(DbscanAuto(0.12, 5, 1.0, 0.8, 0, 0.05), BoxFilter(5, 0.01, 0.0, 0.0, 1e9, 0.0), split=SPLIT)).points.select("point_id", "label")


def remove_structure(points: DataFrame) -> DataFrame:
    got = D.remove_structure(*_halves(points), STRUCTURE)
    return _rounded(got.objects, *G.XYZ).select("point_id", *G.XYZ)


def components(points: DataFrame) -> DataFrame:
    edges = N.near_places(*(points.select(*(F.col(c).alias(p + c) for c in G.XYZ), F.col("point_id").alias(f"{p}id")) for p in "lr"), 0.05)
    return connected_components(edges.where("lid <= rid"), "lid", "rid").select(F.col("node").alias("point_id"), "component")


def object_numbering(points: DataFrame) -> DataFrame:
    return D.number_objects(B.boxes(points).where("n >= 45")).select("label", "seq", "object_name")


def point_numbering(points: DataFrame) -> DataFrame:
    return number_rows(points, ["label"], ["x", "point_id"], "nth").select("point_id", "nth")


def label_compaction(points: DataFrame) -> DataFrame:
    gaps = points.withColumn("label", F.when(F.col("label") % 3 == 0, F.lit(-1)).otherwise(F.col("label") * 7))
    return C.compact(gaps).select("point_id", "label")


def _lines(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    return B.line_sets(D.number_objects(B.boxes(points)))


def aabb_lineset_vertices(points: DataFrame) -> DataFrame:
    return _rounded(_lines(points)[0], *G.XYZ)


def aabb_lineset_edges(points: DataFrame) -> DataFrame:
    return _lines(points)[1]


def oriented_boxes(points: DataFrame) -> DataFrame:
    got = B.oriented_boxes(points)
    sizes = F.array_sort(F.transform("extent", lambda e: F.round(e, 4)))
    return got.select("label", sizes[0].alias("least"), sizes[1].alias("middle"), sizes[2].alias("most"))


def color_labels(points: DataFrame) -> DataFrame:
    some = points.withColumn("label", F.when(F.col("label") == 9, -1).otherwise(F.col("label")))
    return _rounded(T.colour_labels(some), *G.RGB).select("point_id", *G.RGB)


def byte_colors(points: DataFrame) -> DataFrame:
    scaled = points.withColumns({c: F.when(F.col("label") % 2 == 0, F.col(c)).otherwise(F.col(c) * 255) for c in G.RGB})
    return T.byte_colours(scaled, ["label"]).select("point_id", *G.RGB)


def select_points(points: DataFrame) -> DataFrame:
    return T.select_by_id(points, points.where("x > 0")).select("point_id")


def concat_clouds(points: DataFrame) -> DataFrame:
    left, right = _halves(points)
    return _rounded(T.concat(T.paint(left, (1.0, 0.0, 0.0)), right.drop(*G.RGB)), *G.RGB).select("point_id", *G.RGB)


def cloud_bounds(points: DataFrame) -> DataFrame:
    got = S.bounds(points)
    return _rounded(got, *(c for c in got.columns if c != "n"))


def normalize_points(points: DataFrame) -> DataFrame:
    return _rounded(T.normalise(points, ["label"]), *G.XYZ).select("point_id", *G.XYZ)


def density_quantile(points: DataFrame) -> DataFrame:
    return S.below_quantile(points.withColumn("density", F.col("r")), 0.08).select("point_id", "low")


def triangle_shape(points: DataFrame) -> DataFrame:
    return _rounded(M.triangle_shape(_mesh(points)), "max_edge", "area").select("object", "tid", "max_edge", "area")


def triangle_normals(points: DataFrame) -> DataFrame:
    return _rounded(M.triangle_normals(_mesh(points)), *G.NORMAL).select("object", "tid", *G.NORMAL)


def vertex_normals(points: DataFrame) -> DataFrame:
    return _rounded(M.vertex_normals(_welded(points)), *G.NORMAL).select("object", "vid", *G.NORMAL)


def mesh_weld(points: DataFrame) -> DataFrame:
    return _welded(points).triangles.select("object", "tid", "v0", "v1", "v2")


def _damaged(points: DataFrame) -> M.Mesh:
    """The voxel mesh with turned copies of some triangles, and some degenerate ones."""
    mesh = _mesh(points)
    turned = mesh.triangles.where("tid % 5 = 0").select("object", (F.col("tid") + 1_000_000).alias("tid"), F.col("v1").alias("v0"), F.col("v2").alias("v1"), F.col("v0").alias("v2"))
    flat = mesh.triangles.where("tid % 7 = 0").select("object", (F.col("tid") + 2_000_000).alias("tid"), "v0", "v1", F.col("v0").alias("v2"))
    return M.Mesh(mesh.vertices, mesh.triangles.select("object", "tid", "v0", "v1", "v2").unionByName(turned).unionByName(flat))


def mesh_repair(points: DataFrame) -> DataFrame:
    return M.remove_duplicate_triangles(M.remove_degenerate(_damaged(points))).triangles.select("object", "tid")


def mesh_reindex(points: DataFrame) -> DataFrame:
    mesh = M.remove_vertices(_mesh(points), _mesh(points).vertices.where("x > 0").select("object", "vid"))
    return M.reindex(M.remove_unreferenced(mesh)).triangles.select("object", "tid", "v0", "v1", "v2")


def remove_vertices(points: DataFrame) -> DataFrame:
    mesh = _mesh(points)
    return M.remove_vertices(mesh, mesh.vertices.where("x > 0").select("object", "vid")).triangles.select("object", "tid")


def remove_far_vertices(points: DataFrame) -> DataFrame:
    return M.remove_far_vertices(_mesh(points), points, 0.15).vertices.select("object", "vid")


def bad_triangles(points: DataFrame) -> DataFrame:
    return M.bad_triangles(_mesh(points), points, SAMPLE, EDGE, AREA)


def long_triangles(points: DataFrame) -> DataFrame:
    return M.bad_triangles(_mesh(points), points, 0.15, 0.3, centre_only=True)


def mesh_components(points: DataFrame) -> DataFrame:
    return M.component_sizes(_welded(points))


def small_components(points: DataFrame) -> DataFrame:
    return M.remove_small_components(_welded(points), 40).triangles.select("object", "tid")


def largest_component(points: DataFrame) -> DataFrame:
    return M.remove_small_components(_welded(points), only_largest=True).triangles.select("object", "tid")


def taubin_step(points: DataFrame) -> DataFrame:
    return _rounded(M.taubin(_welded(points), 1).vertices, *G.XYZ).select("object", "vid", *G.XYZ)


def _by_corners(mesh: M.Mesh, *names: str) -> DataFrame:
    """``names`` and the corners x0 to z2 of each triangle, turned so that the least corner comes first."""
    corners = M.with_corners(mesh).select(*names, *(F.struct(*(F.round(f"p{i}{c}", DECIMALS).alias(c) for c in G.XYZ)).alias(f"c{i}") for i in range(3)))
    least = F.least("c0", "c1", "c2")
    turned = F.when(F.col("c0") == least, F.array("c0", "c1", "c2")).when(F.col("c1") == least, F.array("c1", "c2", "c0")).otherwise(F.array("c2", "c0", "c1"))
    return corners.select(*names, turned.alias("t")).select(*names, *(F.col("t")[i][c].alias(f"{c}{i}") for i in range(3) for c in G.XYZ))


def combine_meshes(points: DataFrame) -> DataFrame:
    mesh = _mesh(points)
    parts = [M.Mesh(*(t.where(c) for t in (_rounded(mesh.vertices, *G.XYZ), mesh.triangles))) for c in ("object < 5", "object >= 5")]
    return _by_corners(M.combine(parts))


def decimate_mesh(points: DataFrame) -> DataFrame:
    """Triangles of the decimated mesh by their corners, with the number of vertices that each object keeps."""
    mesh = surface.decimate(_welded(points), 100)
    mesh = M.Mesh(*(cut(t) for t in M.remove_unreferenced(mesh)))
    return _by_corners(mesh, "object", "tid").join(mesh.vertices.groupBy("object").agg(F.count("*").alias("vertices")), "object")


def clean_mesh(points: DataFrame) -> DataFrame:
    return M.clean(_damaged(points)).triangles.select("object", "tid", "v0", "v1", "v2")


def non_manifold(points: DataFrame) -> DataFrame:
    """What is left of a welded mesh with a fan of three more triangles at some edges."""
    mesh = _welded(points)
    fans = [mesh.triangles.where(f"tid % 11 = {k}").select("object", (F.col("tid") + 3_000_000 + 100_000 * k).alias("tid"), "v0", "v1", (F.col("v2") + 4 * (k + 1)).alias("v2")) for k in range(3)]
    more = fans[0].unionByName(fans[1]).unionByName(fans[2])
    inside = more.join(mesh.vertices.select("object", F.col("vid").alias("v2")), ["object", "v2"], "left_semi").where("v2 <> v0 and v2 <> v1")
    triangles = mesh.triangles.select("object", "tid", "v0", "v1", "v2").unionByName(inside.select("object", "tid", "v0", "v1", "v2"))
    return M.remove_non_manifold(M.Mesh(mesh.vertices, triangles)).triangles.select("object", "tid")


def taubin_smooth(points: DataFrame) -> DataFrame:
    """All the steps of the refinement."""
    return _rounded(M.taubin(_welded(points.where("label < 2")), Refine().taubin_steps).vertices, *G.XYZ).select("object", "vid", *G.XYZ)


REFINE = Refine(far=0.2, sample=0.16, edge=0.29, area=0.0201, component=10, taubin_steps=1, triangles=400, final_far=0.25)
RECONSTRUCT = Reconstruct(0.25, 20, 0, 1.0, 0.05, 0.2, triangles=400, max_edge=0.4, centre_distance=0.25, component=10, taubin_steps=1, orient_neighbours=8, min_points=50)


def _whole(points: DataFrame) -> DataFrame:
    return points.drop("label").withColumn("object", F.lit(0))


def refine_mesh(points: DataFrame) -> DataFrame:
    """The vertices of the whole cloud's voxel mesh after its refinement, with their normals and colours."""
    whole = _whole(points)
    mesh = M.Mesh(*(cut(t) for t in V.surface_mesh(whole, MESH_SIZE, LEVELS)))
    done = M.refine(M.Mesh(_rounded(mesh.vertices, *G.XYZ), mesh.triangles.select("object", "tid", "v0", "v1", "v2")), whole, REFINE, surface.decimate)
    return _rounded(done.vertices, *G.XYZ, *G.NORMAL, *G.RGB).select("object", "vid", *G.XYZ, *G.NORMAL, *G.RGB)


def voxel_solver(points: DataFrame, depth: int, scale: float) -> M.Mesh:
    """A stand-in for an outside solver: the voxel mesh, with the points near a vertex as its density."""
    mesh = M.Mesh(*(cut(t) for t in V.surface_mesh(points, MESH_SIZE * scale, LEVELS)))
    places = points.select(*G.XYZ).unionByName(mesh.vertices.select(*G.XYZ))
    near = N.radius_count(mesh.vertices, MESH_SIZE, of=places).select("vid", F.col("n_near").cast("double").alias("density"))
    return M.Mesh(_rounded(mesh.vertices.join(near, "vid"), *G.XYZ), mesh.triangles.select("object", "tid", "v0", "v1", "v2"))


def cloud_to_mesh(points: DataFrame) -> DataFrame:
    """The vertices of a mesh of the whole cloud, by a stand-in solver, cleaned, decimated, smoothed and coloured."""
    done = surface.reconstruct(_whole(points), RECONSTRUCT, voxel_solver)
    return _rounded(done.vertices, *G.XYZ, *G.NORMAL, *G.RGB).select("object", "vid", *G.XYZ, *G.NORMAL, *G.RGB)


def _same_sign(normals: DataFrame) -> DataFrame:
    """Normals turned so that their largest component is positive."""
    most = F.greatest(*(F.abs(c) for c in G.NORMAL))
    sign = F.when(F.abs("nx") == most, F.signum("nx")).when(F.abs("ny") == most, F.signum("ny")).otherwise(F.signum("nz"))
    return normals.withColumns({c: F.round(F.col(c) * sign, 4) for c in G.NORMAL})


def estimate_normals(points: DataFrame) -> DataFrame:
    return _same_sign(surface.estimate_normals(points, 0.2, 20)).select("point_id", *G.NORMAL)


def orient_normals(points: DataFrame) -> DataFrame:
    """Normals of each label's points, consistent with their neighbours'."""
    got = surface.orient_normals(surface.estimate_normals(_objects(points), 0.2, 20), 8)
    return got.select("point_id", "object", *(F.round(c, 4).alias(c) for c in G.NORMAL))


def rotate_views(points: DataFrame) -> DataFrame:
    return _rounded(R.rotate_views(points), *G.XYZ).select("point_id", "view", *G.XYZ)


def render_pixels(points: DataFrame) -> DataFrame:
    bytes_ = T.byte_colours(points)
    return R.rasterise(R.rotate_views(_objects(bytes_)), size=32, radius=1)


def label_prompts(points: DataFrame) -> DataFrame:
    return L.prompts(points.sparkSession)


def _logits(points: DataFrame) -> DataFrame:
    """Synthetic scores: an object for each label, four views, and each point as the score of a prompt."""
    n = len(L.LABELS) * len(L.TEMPLATES)
    rows = points.select(F.col("label").alias("object"), F.concat(F.lit("v"), F.col("point_id") % 4).alias("view"), (F.col("point_id") % n).cast("int").alias("prompt_id"), "x")
    return rows.groupBy("object", "view", "prompt_id").agg(F.max("x").alias("logit"))


def label_scores(points: DataFrame) -> DataFrame:
    return _rounded(L.label_scores(L.softmax(_logits(points)), L.prompts(points.sparkSession)), "score")


def top_labels(points: DataFrame) -> DataFrame:
    scores = L.label_scores(L.softmax(_logits(points)), L.prompts(points.sparkSession))
    return _rounded(L.top_labels(_rounded(scores, "score")), *(f"top{i}_score" for i in (1, 2, 3)))


def polygon_area(points: DataFrame) -> DataFrame:
    centred = T.normalise(points.select("point_id", "label", *G.XYZ).withColumn("z", F.lit(0.0)), ["label"])
    ordered = centred.withColumn("turn", F.round(F.atan2("y", "x"), 9))
    numbered = ordered.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("turn", "point_id")))
    return _rounded(P.polygon_area(numbered, "label", "nth"), "area", "perimeter")


def lineitem_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and height percentiles over the largest table."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))
    table = rows.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), *(f(c).alias(a + c) for c in G.XYZ for f, a in ((F.min, "min"), (F.max, "max"))), F.round(F.percentile("y", F.lit(0.01)), DECIMALS).alias("p01")
    )
    return table.withColumnRenamed("l_returnflag", "label")


def lineitem_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Down-sampling of the largest table's three measures."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_discount") * 100).cast("double").alias("y"), (F.col("l_tax") * 100).cast("double").alias("z"))
    return _rounded(V.downsample(rows, 2.5), *G.XYZ)


_OF_CLOUD = (
    voxel_downsample, voxel_grid, exposed_faces, voxel_mesh_counts, voxel_mesh_vertices, voxel_mesh_triangles, centred_mesh, color_quantize,
    rigid_align, rigid_roundtrip, cluster_aabb, bbox_filter, big_clusters, expand_boxes, crop_points, radius_count, radius_outlier, outlier_counts,
    bridge_cut, near_distance, nn_distance, structure_anti_join, removed_points, match_rate, color_transfer, floor_percentile, floating_clusters,
    dbscan_labels, dbscan_groups, dbscan_auto, dbscan_auto_floor, cluster_fraction, merge_clusters, split_clusters, detect_objects, detect_merged,
    detect_split, remove_structure, components, object_numbering, point_numbering, label_compaction, aabb_lineset_vertices, aabb_lineset_edges,
    oriented_boxes, color_labels, byte_colors, select_points, concat_clouds, cloud_bounds, normalize_points, density_quantile, triangle_shape,
    triangle_normals, vertex_normals, mesh_weld, mesh_repair, mesh_reindex, remove_vertices, remove_far_vertices, bad_triangles, long_triangles,
    mesh_components, small_components, largest_component, taubin_step, combine_meshes, decimate_mesh, clean_mesh, estimate_normals, orient_normals,
    non_manifold, taubin_smooth, refine_mesh, cloud_to_mesh, rotate_views,
    render_pixels, label_prompts, label_scores, top_labels, polygon_area,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of_cloud(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: f(cloud(spark, sf_dir))

    return {f.__name__: of_cloud(f) for f in _OF_CLOUD} | {"lineitem_boxes": lineitem_boxes, "lineitem_voxels": lineitem_voxels}
