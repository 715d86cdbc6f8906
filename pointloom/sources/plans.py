"""Room plans and alignments from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pointloom.operators.transform import Alignment

_PLAN = (
    "room_summary struct<shape:string,num_corners:int,floor_area_m2:double,room_height_m:double,volume_m3:double>, "
    "walls array<struct<wall_id:int,width_m:double,height_m:double,area_m2:double,angle_deg:double,start_point:array<double>,end_point:array<double>>>"
)


def read_plans(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(summaries: plan, shape, ...; walls: plan, wall_id, ..., x0, y0, x1, y1); a plan is named by its file's path."""
    raw = spark.read.schema(_PLAN).json(paths, multiLine=True).withColumn("plan", F.input_file_name())
    walls = raw.select("plan", F.explode("walls").alias("w"))
    ends = [F.col(f"w.{p}")[i].alias(f"{c}{k}") for k, p in enumerate(("start_point", "end_point")) for i, c in enumerate("xy")]
    return raw.select("plan", "room_summary.*"), walls.select("plan", *(f"w.{c}" for c in ("wall_id", "width_m", "height_m", "area_m2", "angle_deg")), *ends)


def read_alignment(spark: SparkSession, path: str) -> Alignment:
    """The rigid transform in a JSON file; fails if it is missing. Pickles are not read."""
    schema = "alignment struct<centroid:array<double>,R:array<array<double>>>"
    row = spark.read.schema(schema).json(path, multiLine=True).first()
    if row is None or row.alignment is None or row.alignment.centroid is None or row.alignment.R is None:
        raise ValueError("no alignment with centroid and R")
    return Alignment(tuple(row.alignment.centroid), tuple(map(tuple, row.alignment.R)))
