import json
import struct

import pytest
from pyspark.sql import functions as F

from pointloom.operators import boxes as B, detect as D, mesh as M, plan as P, voxel as V
from pointloom.sources import files, plans, ply, writers
from pointloom.streaming.voxels import stream_voxels


@pytest.fixture
def points(spark):
    rows = [(i, 0.1 * i, -0.05 * i, 1.0 / (i + 1), i / 9, 0.5, 1.0, "o") for i in range(10)]
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double, r double, g double, b double, object string")


def test_points_survive_ply(spark, points, tmp_path):
    assert writers.write_points(points.repartition(4), f"{tmp_path}/object_001.ply")
    got = ply.read_points(spark, f"{tmp_path}/*.ply").orderBy("point_id").collect()
    for g, w in zip(got, points.orderBy("point_id").collect(), strict=True):
        assert (g.object, g.x, g.y, g.z) == ("object_001", w.x, w.y, w.z) and g.r == pytest.approx(w.r, abs=0.002) and g.nx is None
    assert not writers.write_points(points.limit(0), f"{tmp_path}/none.ply") and not (tmp_path / "none.ply").exists()


def test_broken_files_fail(spark, tmp_path):
    (tmp_path / "a.ply").write_bytes(b"nothing")
    with pytest.raises(Exception, match="not a PLY file"):
        ply.read_points(spark, str(tmp_path / "a.ply")).collect()


def test_line_sets_survive_ply(spark, points, tmp_path):
    table = D.number_objects(B.boxes(points.withColumn("label", F.col("point_id") % 2)))
    assert writers.write_line_set(table, f"{tmp_path}/boxes.ply")
    vertices, edges = ply.read_line_set(spark, f"{tmp_path}/boxes.ply")
    assert vertices.count() == 16 and edges.count() == 24
    assert edges.orderBy("eid").collect()[12][2:] == (8, 9, 1.0, 0.0, 0.0)
    assert not writers.write_line_set(table.limit(0), f"{tmp_path}/none.ply")


def test_meshes_survive_binary_ply(spark, points, tmp_path):
    mesh = M.Mesh(*V.surface_mesh(points, 0.3, 8))
    coloured = M.Mesh(M.vertex_normals(M.Mesh(mesh.vertices.withColumns({c: F.lit(0.2) for c in "rgb"}), mesh.triangles)), mesh.triangles)
    assert writers.write_mesh(coloured, f"{tmp_path}/m.ply")
    vertices, triangles = ply.read_mesh(spark, f"{tmp_path}/m.ply")
    key = lambda df, *c: [tuple(r) for r in df.select(*c).orderBy(c[0]).collect()]
    assert key(vertices, "vid", "x", "y", "z", "nx") == key(coloured.vertices, "vid", "x", "y", "z", "nx")
    assert key(triangles, "tid", "v0", "v1", "v2") == key(mesh.triangles, "tid", "v0", "v1", "v2")
    assert not writers.write_mesh(M.Mesh(mesh.vertices, mesh.triangles.limit(0)), f"{tmp_path}/none.ply")


def test_big_endian_and_polygons(spark, tmp_path):
    head = b"ply\nformat binary_big_endian 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_index\nend_header\n"
    body = b"".join(struct.pack(">3f", x, y, 0) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))) + struct.pack(">B4i", 4, 0, 1, 2, 3)
    (tmp_path / "q.ply").write_bytes(head + body)
    _, triangles = ply.read_mesh(spark, str(tmp_path / "q.ply"))
    assert [tuple(r)[2:] for r in triangles.orderBy("tid").collect()] == [(0, 1, 2), (0, 2, 3)]


def test_decimals_are_those_of_the_exact_value(spark, tmp_path):
    """Ties go to even, and no digit is lost that the shortest decimal leaves out."""
    values = (53 / 512, -53 / 512, 55 / 512, 0.5 / 10**8, 1234567890.1234567, 1e23, -1e-12, 0.0)
    df = spark.createDataFrame([(i, v, v, None) for i, v in enumerate(values)], "point_id long, x double, y double, z double")
    writers.write_xyz(df.repartition(3), f"{tmp_path}/xyz")
    got = spark.read.option("header", True).schema("x string, y string, z string").csv(f"{tmp_path}/xyz").collect()
    assert sorted(tuple(r) for r in got) == sorted((f"{v:.8f}", f"{v:.8f}", None) for v in values)
    assert "0.10351562" in {r.x for r in got}
    triangles = spark.createDataFrame([("m", 1, 0, 128)], "material string, qr int, qg int, qb int")
    writers.write_mtl(triangles, f"{tmp_path}/a.mtl", 129)
    assert "Ka 0.007812 0.000000 1.000000" in (tmp_path / "a.mtl").read_text().split("\n")


def test_obj_with_materials(points, tmp_path):
    vertices, triangles = V.surface_mesh(points, 0.3, 8)
    writers.write_obj(vertices, triangles, f"{tmp_path}/o_voxel.obj", 8, ("voxel_size: 0.3",))
    lines = (tmp_path / "o_voxel.obj").read_text().splitlines()
    faces = [line for line in lines if line.startswith("f ")]
    assert len(faces) == triangles.count() and faces[0] == "f 1 2 3" and faces[1] == "f 1 3 4"
    assert lines[1] == "mtllib o_voxel.mtl"
    used = [line for line in lines if line.startswith("usemtl")]
    assert all(a != b for a, b in zip(used, used[1:]))
    assert set(x.split()[1] for x in used) == {line.split()[1] for line in (tmp_path / "o_voxel.mtl").read_text().splitlines() if line.startswith("newmtl")}


def test_descriptions_tables_and_images(spark, points, tmp_path):
    table = D.number_objects(B.boxes(points.withColumn("label", F.lit(3))))
    writers.write_json(writers.object_meta(table), f"{tmp_path}/meta")
    got = spark.read.json(f"{tmp_path}/meta").first()
    assert (got.object_name, got.source_cluster_label, got.point_count, got.point_max_bound.x) == ("object_001", 3, 10, 0.9)
    writers.write_xyz(points, f"{tmp_path}/xyz", ("object",))
    rows = spark.read.option("header", True).csv(f"{tmp_path}/xyz")
    assert rows.count() == 10 and "0.10000000" in {r.x for r in rows.collect()}
    writers.write_json(writers.voxel_meta(V.mesh_counts(points, 0.3, 8), 0.3, 8), f"{tmp_path}/voxels")
    assert spark.read.json(f"{tmp_path}/voxels").first().input_point_count == 10
    writers.write_predictions(spark.createDataFrame([("a.ply", 3, "bed", 0.5)], "file_name string, num_points int, top1_label string, top1_score double"), f"{tmp_path}/pred")
    assert spark.read.option("header", True).csv(f"{tmp_path}/pred").first().top1_label == "bed"
    assert writers.write_images(spark.createDataFrame([("o", "front", bytearray(b"png"))], "object string, view string, png binary"), f"{tmp_path}/img") == 1
    assert (tmp_path / "img/o/front.png").read_bytes() == b"png"
    assert files.listing(spark, f"{tmp_path}/img/o/*.png").first().name == "front"
    assert writers.clear(f"{tmp_path}/img/o", "fr") == 1 and writers.clear(f"{tmp_path}/nowhere", "x") == 0
    assert files.resolve("a/b.ply", "/root/") == "/root/a/b.ply" and files.resolve("/a", "/b") == "/a" and files.resolve("s3://a", "/b") == "s3://a"


def test_room_plans(spark, tmp_path):
    corners = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
    walls = [
        {"wall_id": i + 1, "width_m": w, "height_m": 2.5, "area_m2": w * 2.5, "angle_deg": a, "start_point": list(corners[i]), "end_point": list(corners[(i + 1) % 4])}
        for i, (w, a) in enumerate(((4.0, 0.0), (3.0, 90.0), (4.0, -180.0), (3.0, -90.0)))
    ]
    summary = {"shape": "Rectangle", "num_corners": 4, "floor_area_m2": 12.0, "room_height_m": 2.5, "volume_m3": 30.0}
    (tmp_path / "room.json").write_text(json.dumps({"room_summary": summary, "walls": walls}, indent=2))
    summaries, table = plans.read_plans(spark, f"{tmp_path}/room.json")
    got = P.plan_checks(summaries, table).first()
    assert got.shoelace_m2 == 12.0 and got.area_ok and got.volume_ok and got.corners_ok
    assert all(r.width_ok and r.area_ok and r.angle_ok and r.closed_ok for r in P.wall_checks(table).collect())
    (tmp_path / "a.json").write_text(json.dumps({"alignment": {"centroid": [1, 2, 3], "R": [[1, 0, 0], [0, 1, 0], [0, 0, 1]]}}))
    assert plans.read_alignment(spark, f"{tmp_path}/a.json").centroid == (1, 2, 3)
    (tmp_path / "b.json").write_text("{}")
    with pytest.raises(ValueError):
        plans.read_alignment(spark, f"{tmp_path}/b.json")


def test_streamed_voxels(spark, points, tmp_path):
    points.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(points.schema).parquet(f"{tmp_path}/in")
    query = stream_voxels(stream, 0.25).writeStream.outputMode("complete").format("memory").queryName("voxels").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.ix, r.iy, r.iz): r.n for r in spark.table("voxels").collect()}
    want = {(r.ix, r.iy, r.iz): r.n for r in stream_voxels(points, 0.25).collect()}
    assert got == want and sum(got.values()) == 10
