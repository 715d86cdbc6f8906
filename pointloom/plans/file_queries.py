"""Registered queries that write files, read them again and return what they read."""

from __future__ import annotations

import json
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from pointloom.functions import geometry as G
from pointloom.operators import boxes as B, detect as D, mesh as M, neighbours as N, plan as P, render as R, transform as T, voxel as V
from pointloom.plans import queries as Q
from pointloom.plans.lineage import ensure_checkpoint_dir
from pointloom.sources import files, plans, ply, writers
from pointloom.sources.sink import Sink
from pointloom.streaming.voxels import stream_voxels

HALF_WALL, HEIGHT = 0.5, 2.5
STREAM_SIZE = 0.2
PATHS = (("ply/a.ply", "/data"), ("/ply/a.ply", "/data"), ("s3a://bucket/a.ply", "/data"), ("a.ply", "/data/"))
OLD_FILES = ("object_001.ply", "object_002.ply", "07_bridges.ply", "keep.ply")


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share, deleted when the application ends."""
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid4()}"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, Q.DECIMALS) for c in names})


def _one_object(points: DataFrame) -> DataFrame:
    return points.withColumn("object", F.lit(0))


def file_points(points: DataFrame) -> DataFrame:
    path = f"{_folder(points.sparkSession)}/cloud.ply"
    writers.write_points(points, path)
    return _rounded(ply.read_points(points.sparkSession, path), *G.XYZ, *G.RGB).select("object", "point_id", *G.XYZ, *G.RGB)


def file_removed(points: DataFrame) -> DataFrame:
    """The points near the structure, painted red, as a file of their own."""
    left, right = Q._halves(points)
    path = f"{_folder(points.sparkSession)}/removed.ply"
    writers.write_points(T.paint(T.difference(left, N.remove_near(left, right, Q.RADIUS)), (1.0, 0.0, 0.0)), path)
    return _rounded(ply.read_points(points.sparkSession, path), *G.XYZ).select("object", "point_id", *G.XYZ, *G.RGB)


def _line_set(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    path = f"{_folder(points.sparkSession)}/boxes.ply"
    writers.write_line_set(D.number_objects(B.boxes(points)), path)
    return ply.read_line_set(points.sparkSession, path)


def file_line_set_vertices(points: DataFrame) -> DataFrame:
    return _rounded(_line_set(points)[0], *G.XYZ)


def file_line_set_edges(points: DataFrame) -> DataFrame:
    return _line_set(points)[1]


def _mesh_file(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    path = f"{_folder(points.sparkSession)}/mesh.ply"
    writers.write_mesh(M.Mesh(*V.surface_mesh(_one_object(points), Q.MESH_SIZE, Q.LEVELS)), path)
    return ply.read_mesh(points.sparkSession, path)


def file_mesh_vertices(points: DataFrame) -> DataFrame:
    return _rounded(_mesh_file(points)[0], *G.XYZ).select("object", "vid", *G.XYZ)


def file_mesh_triangles(points: DataFrame) -> DataFrame:
    return _mesh_file(points)[1]


def _flat(df: DataFrame) -> DataFrame:
    """Nested x, y, z as columns of their own, rounded."""
    nested = [f.name for f in df.schema if f.dataType.typeName() == "struct"]
    plain = [c for c in df.columns if c not in nested]
    return df.select(*plain, *(F.round(f"{n}.{c}", Q.DECIMALS).alias(f"{n}_{c}") for n in nested for c in G.XYZ))


def _through_json(df: DataFrame) -> DataFrame:
    path = f"{_folder(df.sparkSession)}/meta"
    writers.write_json(df, path)
    return df.sparkSession.read.schema(df.schema).json(path)


def file_object_meta(points: DataFrame) -> DataFrame:
    return _flat(_through_json(writers.object_meta(D.number_objects(B.boxes(points))))).drop("note")


def file_voxel_meta(points: DataFrame) -> DataFrame:
    return _flat(_through_json(writers.describe_voxel_meshes(Q._objects(points), Q.MESH_SIZE, Q.LEVELS, "out"))).drop("note")


def file_xyz(points: DataFrame) -> DataFrame:
    path = f"{_folder(points.sparkSession)}/xyz"
    writers.write_xyz(points, path, ("label",))
    return points.sparkSession.read.schema("x string, y string, z string, label int").option("header", True).csv(path)


def _lines(points: DataFrame, ending: str) -> DataFrame:
    """(line, n): how often a line stands in the OBJ or MTL file of the whole cloud's voxel mesh; comments and empty lines are left out."""
    folder = _folder(points.sparkSession)
    writers.write_obj(*V.surface_mesh(_one_object(points), Q.MESH_SIZE, Q.LEVELS), f"{folder}/cloud.obj", Q.LEVELS, ("a comment",))
    lines = points.sparkSession.read.text(f"{folder}/cloud.{ending}").withColumnRenamed("value", "line")
    return lines.where("line <> '' and line not like '#%'").groupBy("line").agg(F.count("*").alias("n"))


def file_obj(points: DataFrame) -> DataFrame:
    return _lines(points, "obj")


def file_mtl(points: DataFrame) -> DataFrame:
    return _lines(points, "mtl")


def file_predictions(points: DataFrame) -> DataFrame:
    rows = Q.top_labels(points)
    path = f"{_folder(points.sparkSession)}/predictions"
    writers.write_predictions(rows, path)
    return points.sparkSession.read.schema(rows.schema).option("header", True).csv(path)


def file_images(points: DataFrame) -> DataFrame:
    """(object, view, white): the images' files, and the pixels that no point covers, counted in the files read again."""
    folder = _folder(points.sparkSession)
    writers.write_images(R.images(Q.render_pixels(points), size=32), folder)
    read = points.sparkSession.read.format("binaryFile").load(f"{folder}/*/*.png").select("path", "content")

    @F.pandas_udf("long")
    def white(contents):
        import zlib

        import numpy as np
        import pandas as pd

        out = []
        for data in contents:
            at = data.index(b"IDAT")
            size = int.from_bytes(data[at - 4 : at])
            image = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + size]), np.uint8).reshape(32, -1)[:, 1:].reshape(32, 32, 3)
            out.append(int((image == 255).all(axis=2).sum()))
        return pd.Series(out)

    parts = F.split("path", "/")
    named = read.select(F.element_at(parts, -2).cast("int").alias("object"), F.regexp_replace(F.element_at(parts, -1), r"\.png$", "").alias("view"), white("content").alias("white"))
    return named


def file_listing(points: DataFrame) -> DataFrame:
    """Names of the files that are left when those of a run before are cleared."""
    folder = _folder(points.sparkSession)
    for name in OLD_FILES:
        with Sink(f"{folder}/{name}") as f:
            f.write("ply\n")
    gone = sum(writers.clear(folder, prefix) for prefix in ("object_", "07_", "08_"))
    return files.listing(points.sparkSession, f"{folder}/*.ply").select("name", "length", F.lit(gone).alias("cleared"))


def file_paths(points: DataFrame) -> DataFrame:
    rows = [(path, root, files.resolve(path, root)) for path, root in PATHS]
    return points.sparkSession.createDataFrame(rows, "path string, root string, resolved string")


def _plans(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A rectangular room a label, the box of its points seen from above, as JSON files. Every third one is described wrongly."""
    spark, folder = points.sparkSession, _folder(points.sparkSession)
    table = B.boxes(points).select("label", *(F.round(c, 3).alias(c) for c in ("minx", "minz", "maxx", "maxz")))
    for r in table.toLocalIterator():
        corners = [(r.minx, r.minz), (r.maxx, r.minz), (r.maxx, r.maxz), (r.minx, r.maxz)]
        off = HALF_WALL if r.label % 3 == 0 else 0.0
        walls = []
        for i, (angle, (x0, y0)) in enumerate(zip((0.0, 90.0, 180.0, -90.0), corners, strict=True)):
            x1, y1 = corners[(i + 1) % 4]
            width = abs(x1 - x0) + abs(y1 - y0) + off
            walls.append({"wall_id": i + 1, "width_m": width, "height_m": HEIGHT, "area_m2": width * HEIGHT, "angle_deg": angle, "start_point": [x0, y0], "end_point": [x1, y1]})
        area = (r.maxx - r.minx) * (r.maxz - r.minz) + off
        summary = {"shape": "Rectangle", "num_corners": 4, "floor_area_m2": area, "room_height_m": HEIGHT, "volume_m3": area * HEIGHT}
        with Sink(f"{folder}/room_{r.label}.json") as f:
            f.write(json.dumps({"room_summary": summary, "walls": walls}, indent=2))
    named = F.regexp_extract("plan", r"room_(-?\d+)\.json$", 1).cast("int")
    summaries, walls = plans.read_plans(spark, f"{folder}/*.json")
    return summaries.withColumn("plan", named), walls.withColumn("plan", named)


def plan_walls(points: DataFrame) -> DataFrame:
    walls = _plans(points)[1]
    return P.wall_checks(walls).join(walls.select("plan", "wall_id", F.round("width_m", 6).alias("width_m"), "x0", "y0", "x1", "y1"), ["plan", "wall_id"])


def plan_checks(points: DataFrame) -> DataFrame:
    return _rounded(P.plan_checks(*_plans(points)), "shoelace_m2")


def file_alignment(points: DataFrame) -> DataFrame:
    """Points aligned by a transform that was read from a file."""
    spark, path = points.sparkSession, f"{_folder(points.sparkSession)}/alignment.json"
    with Sink(path) as f:
        f.write(json.dumps({"alignment": {"centroid": list(Q.ALIGNMENT.centroid), "R": [list(r) for r in Q.ALIGNMENT.rotation]}}))
    return _rounded(T.align(points, plans.read_alignment(spark, path)), *G.XYZ).select("point_id", *G.XYZ)


def voxel_stream(points: DataFrame) -> DataFrame:
    """Voxel counts of the cloud, read as a stream of files."""
    spark, folder = points.sparkSession, _folder(points.sparkSession)
    points.select("point_id", *G.XYZ).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("point_id long, x double, y double, z double").option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    counts = stream_voxels(stream, STREAM_SIZE).writeStream.outputMode("complete").trigger(availableNow=True)
    counts = counts.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out"))
    counts.option("checkpointLocation", f"{folder}/state").start().awaitTermination()
    return _rounded(spark.read.parquet(f"{folder}/out"), *G.XYZ).select(*V.CELL, *G.XYZ, "n")


_OF_CLOUD = (
    file_points, file_removed, file_line_set_vertices, file_line_set_edges, file_mesh_vertices, file_mesh_triangles, file_object_meta, file_voxel_meta,
    file_xyz, file_obj, file_mtl, file_predictions, file_images, file_listing, file_paths, plan_walls, plan_checks, file_alignment, voxel_stream,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of_cloud(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: f(Q.cloud(spark, sf_dir))

    return {f.__name__: of_cloud(f) for f in _OF_CLOUD}
