"""The pipelines: structure removal, object detection and numbering of objects."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from pointloom.operators.boxes import boxes, good
from pointloom.operators.cluster import dbscan_auto, floating_clusters, floor_height, merge_clusters, split_clusters
from pointloom.operators.neighbours import radius_outliers, remove_near
from pointloom.operators.voxel import downsample
from pointloom.plans.lineage import cut
from pointloom.plans.numbering import number_rows, ranks
from pointloom.plans.params import Detect, Structure


class Detected(NamedTuple):
    """Points of the objects found (with ``label``), what was removed, the objects' numbered boxes and the radius used."""

    points: DataFrame
    removed: DataFrame
    boxes: DataFrame
    eps: float


def number_objects(table: DataFrame) -> DataFrame:
    """Boxes with ``seq`` from 1 in the order of labels, and ``object_name``. Labels keep the gaps of what was filtered."""
    numbered = ranks(table, ["label"], "seq").withColumn("seq", F.col("seq").cast("int"))
    return numbered.withColumn("object_name", F.concat(F.lit("object_"), F.lpad(F.col("seq").cast("string"), 3, "0")))


def detect_objects(points: DataFrame, p: Detect) -> Detected:
    """Clusters points with ``point_id``, x, y, z, optionally merges or splits clusters, and filters them by their boxes.

    Points of a split cluster that no part takes are dropped; of those only bridges
    count as removed. Noise and filtered clusters are removed. An empty cloud, or one
    in which all is noise, gives empty results.
    """
    labelled, eps = dbscan_auto(points, p.clusters)
    if p.merge:
        labelled = cut(merge_clusters(labelled, p.merge))
    bridges = None
    if p.split:
        parted = cut(split_clusters(labelled, p.split, eps))
        bridges = parted.where("removed").drop("part", "removed")
        known = parted.where("label >= 0 and part is not null")
        table = ranks(known.select("label", "part").distinct(), ["label", "part"], "__new").withColumn("__new", (F.col("__new") - 1).cast("int"))
        labelled = known.join(table, ["label", "part"]).withColumn("label", F.col("__new")).drop("part", "removed", "__new")
        labelled = cut(labelled.unionByName(parted.where("label < 0").drop("part", "removed")))
    found = cut(number_objects(good(boxes(labelled.where("label >= 0")), p.boxes)))
    kept = labelled.join(found.select("label"), "label", "left_semi")
    removed = labelled.join(found.select("label"), "label", "left_anti")
    return Detected(kept, removed.unionByName(bridges) if bridges is not None else removed, found, eps)


class Cleaned(NamedTuple):
    """What is left after each step of structure removal, and the floor's height."""

    room: DataFrame
    without_structure: DataFrame
    without_outliers: DataFrame
    objects: DataFrame
    floor: float | None


def remove_structure(room: DataFrame, structure: DataFrame, p: Structure) -> Cleaned:
    """Down-samples both clouds, takes the structure, outliers and small floating clusters out of the room.

    Points are numbered in the order of their cells, so that labels do not depend on partitions.
    """
    small = downsample(room, p.voxel).withColumn("__all", F.lit(0))
    small = cut(number_rows(small, ["__all"], ["ix", "iy", "iz"], "point_id").drop("__all", "ix", "iy", "iz", "n"))
    target = cut(downsample(structure, p.voxel).select("x", "y", "z"))
    bare = cut(remove_near(small, target, p.remove_radius))
    calm = cut(radius_outliers(bare, p.outlier_radius, p.outlier_points).where("keep").drop("keep"))
    floor = floor_height(small, p)
    if floor is None:
        return Cleaned(small, bare, calm, calm, None)
    objects = floating_clusters(calm, p, floor).where("not floating").drop("label", "floating")
    return Cleaned(small, bare, calm, objects, floor)
