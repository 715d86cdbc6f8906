"""Density clustering and what is built on it: automatic radius, merging, splitting, floating clusters."""

from __future__ import annotations

import math

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from pointloom.functions import geometry as G
from pointloom.operators.boxes import CENTRE, HIGH, LOW, boxes, is_big
from pointloom.operators.graph import connected_components
from pointloom.operators.neighbours import _at_places, _places, crowded, has_near, near_places
from pointloom.operators.statistics import percentiles
from pointloom.plans.lineage import cut, stored
from pointloom.plans.numbering import number_rows, ranks
from pointloom.plans.params import DbscanAuto, Merge, Split, Structure

NOISE = -1


def compact(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Labels renumbered 0, 1, ... in their order; noise (negative or null) is -1. Only the distinct labels are put in order."""
    known = labelled.where(F.col(label) >= 0).select(F.col(label).alias("__old")).distinct()
    table = ranks(known, ["__old"], "__new").withColumn("__new", F.col("__new") - 1)
    joined = labelled.join(table, F.col(label) == F.col("__old"), "left")
    return joined.withColumn(label, F.coalesce("__new", F.lit(NOISE)).cast("int")).drop("__old", "__new")


def _heads(core: DataFrame, eps: float, keys: list[str]) -> DataFrame:
    """Core places with ``head``, the first of their small cell. Its diagonal is below ``eps``, so all of a cell are in one cluster."""
    side = eps / math.sqrt(3) * 0.999
    fine = core.withColumns({f"f{c}": G.cell(F.col(f"r{c}"), F.lit(0.0), side) for c in G.XYZ})
    head = fine.groupBy(*keys, "fx", "fy", "fz").agg(F.min("rid").alias("head"))
    return fine.join(head, [*keys, "fx", "fy", "fz"]).drop("fx", "fy", "fz")


class Places(NamedTuple):
    """Distinct places (``keys``, r*, n, rid) of a cloud, and the pairs (lid, rid, d2) of their ids, lid < rid, up to a radius, if those were stored."""

    spots: DataFrame
    pairs: DataFrame | None = None


#: Pairs of places are stored, to be filtered for smaller radii, if there are at most so many a place.
STORED_PAIRS = 64


def places_of(points: DataFrame, keys: list[str]) -> Places:
    return Places(cut(_places(points, "r", keys, F.count("*").alias("n"), F.min("point_id").alias("rid"))))


def with_pairs(places: Places, radius: float, keys: list[str], most: int = STORED_PAIRS) -> Places:
    """Joins the places up to ``radius`` once, for any radius that is not larger."""
    sides = [places.spots.select(*keys, *(F.col(f"r{c}").alias(f"{p}{c}") for c in G.XYZ), F.col("rid").alias(f"{p}id")) for p in "lr"]
    pairs = near_places(*sides, radius, keys).where("lid < rid").select("lid", "rid", "d2")
    return places._replace(pairs=stored(pairs)) if pairs.count() <= most * places.spots.count() else places


def _linked(left: DataFrame, right: DataFrame, eps: float, keys: list[str], pairs: DataFrame | None) -> DataFrame:
    """Pairs within ``eps`` of places ``left`` and ``right``, which have a rid and one more column each."""
    (a,), (b,) = ([c for c in t.columns if c not in (*keys, "rx", "ry", "rz", "rid")] for t in (left, right))
    if pairs is None:
        turned = left.select(*keys, *(F.col(f"r{c}").alias(f"l{c}") for c in G.XYZ), F.col("rid").alias("lid"), a)
        return near_places(turned, right.select(*keys, *(f"r{c}" for c in G.XYZ), "rid", b), eps, keys).select("lid", "rid", a, b)
    near = pairs.where(F.col("d2") <= eps * eps)
    both = near.select("lid", "rid").unionByName(near.select(F.col("rid").alias("lid"), F.col("lid").alias("rid")))
    return both.join(left.select(F.col("rid").alias("lid"), a), "lid").join(right.select("rid", b), "rid").select("lid", "rid", a, b)


def dbscan(points: DataFrame, eps: float, min_points: int, by: list[str] | None = None, numbered: bool = True, places: Places | None = None) -> DataFrame:
    """Adds ``core``, ``cluster`` and ``label`` to points with ``point_id``, x, y, z.

    A point with at least ``min_points`` points within ``eps``, itself included, is a
    core point. ``cluster`` is the least point_id of the core points that are linked; a
    point that is not core but near core points takes the least cluster of those, others
    are noise (null). ``label`` numbers the clusters from 0 in that order, noise is -1.
    With ``by``, each group is clustered by itself; labels then count over all groups.

    The labels do not depend on the order or partitioning of the rows. Copies of a
    point count, but are joined once. Points without a place are noise. ``places`` are
    those of the points, maybe with pairs up to ``eps`` at least, to be used again.
    """
    keys = list(by or [])
    spots, pairs = places or places_of(points, keys)
    at = [*keys, "rx", "ry", "rz"]
    if pairs is None:
        marked = crowded(spots, eps, min_points, keys)
    else:
        met = _linked(spots.select(*at, "rid", F.lit(0).alias("own")), spots.select(*at, "rid", "n"), eps, keys, pairs)
        counts = met.groupBy(F.col("lid").alias("rid")).agg(F.sum("n").alias("near"))
        marked = spots.join(counts, "rid", "left").withColumn("crowded", F.col("n") + F.coalesce("near", F.lit(0)) >= min_points).drop("near")
    marked = cut(marked.withColumnRenamed("crowded", "core"))
    core = cut(_heads(marked.where("core"), eps, keys).select(*at, "rid", "head"))
    links = _linked(core.withColumnRenamed("head", "u"), core.withColumnRenamed("head", "v"), eps, keys, pairs).where("u < v").select("u", "v").distinct()
    links = links.unionByName(core.select(F.col("head").alias("u"), F.col("rid").alias("v")))
    component = connected_components(links, "u", "v").select(F.col("node").alias("rid"), F.col("component").alias("cluster"))
    clustered = cut(core.drop("head").join(component, "rid"))
    edge = marked.where("not core").select(*at, "rid", F.lit(0).alias("edge"))
    border = _linked(edge, clustered, eps, keys, pairs).groupBy(F.col("lid").alias("rid")).agg(F.min("cluster").alias("cluster"))
    border = marked.where("not core").join(border, "rid").select(*at, "cluster", F.lit(False).alias("core"))
    table = clustered.select(*at, "cluster", F.lit(True).alias("core")).unionByName(border)
    table = table.withColumnsRenamed({f"r{c}": f"l{c}" for c in G.XYZ})
    out = _at_places(points, cut(table), keys).withColumn("core", F.coalesce("core", F.lit(False)))
    return number_clusters(out) if numbered else out


def number_clusters(clustered: DataFrame) -> DataFrame:
    """Adds ``label``: 0, 1, ... in the order of ``cluster``, -1 where that is null."""
    order = ranks(clustered.select("cluster").where("cluster is not null").distinct(), ["cluster"], "label")
    order = order.select(F.col("cluster").alias("__c"), (F.col("label") - 1).cast("int").alias("label"))
    out = clustered.join(order, F.col("cluster") == F.col("__c"), "left").drop("__c")
    return out.withColumn("label", F.coalesce("label", F.lit(NOISE)))


def largest_fraction(labelled: DataFrame, label: str = "label") -> float:
    """Share of all points, noise included, in the largest cluster; 1 without clusters or points. Noise is negative or null."""
    sizes = labelled.groupBy(label).agg(F.count("*").alias("n"))
    got = sizes.agg(F.max(F.when(F.col(label) >= 0, F.col("n"))).alias("most"), F.sum("n").alias("all")).first()
    return got.most / got["all"] if got.most else 1.0


def tries(p: DbscanAuto) -> list[float]:
    """The radii in the order in which they are tried; repeats, which change nothing, are left out."""
    out, eps = [p.eps], p.eps
    for _ in range(p.retries):
        eps = max(p.eps_min, eps * p.shrink)
        if eps == out[-1] or (p.stop_at_floor and eps <= p.eps_min):
            break
        out.append(eps)
    return out


def dbscan_auto(points: DataFrame, p: DbscanAuto) -> tuple[DataFrame, float]:
    """Clusters with ever smaller radii until the largest cluster's share is small enough; the last try counts.

    Places are joined once, at the largest radius, and the pairs filtered for the smaller ones.
    """
    radii = tries(p)
    places, result, used = places_of(points, []), None, p.eps
    if len(radii) > 1:
        places = with_pairs(places, max(radii), [])
    for eps in radii:
        result, used = cut(dbscan(points, eps, p.min_points, numbered=False, places=places)), eps
        if eps == radii[-1] or largest_fraction(result, "cluster") <= p.max_fraction:
            break
    return cut(number_clusters(result)), used


def merge_edges(table: DataFrame, distance: float) -> DataFrame:
    """(u, v): boxes at most ``distance`` apart among those whose centres lie in the same or adjoining cells of twice that."""
    cells = {f"c{c}": G.cell(F.col(f"centre{c}"), F.lit(0.0), 2 * distance) for c in G.XYZ}
    own = table.withColumns(cells).select("label", *LOW, *HIGH, *cells)
    near = own.select(*(F.col(c).alias("o" + c) for c in own.columns))
    for c in G.XYZ:
        near = near.withColumn("d", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(f"c{c}", F.col(f"oc{c}") + F.col("d")).drop("d", f"oc{c}")
    met = own.join(near, list(cells)).where("label < olabel")
    gap = G.box_gap(G.columns(LOW), G.columns(HIGH), G.columns(LOW, "o"), G.columns(HIGH, "o"))
    return met.where(gap <= F.lit(distance * distance)).select(F.col("label").alias("u"), F.col("olabel").alias("v"))


def merge_clusters(labelled: DataFrame, p: Merge) -> DataFrame:
    """Joins clusters of enough points whose boxes nearly touch, then renumbers the labels.

    Labels of the clusters that are too small to take part come first, then the merged
    ones in the order of their least label. Fewer than two large ones: nothing changes.
    """
    table = boxes(labelled.where("label >= 0")).where(F.col("n") >= p.min_points)
    table = cut(table.select("label", *LOW, *HIGH, *CENTRE))
    if table.limit(2).count() < 2:
        return labelled
    alone = table.select(F.col("label").alias("u"), F.col("label").alias("v"))
    merged = connected_components(merge_edges(table, p.distance).unionByName(alone), "u", "v")
    offset = labelled.agg(F.max("label") + 1).first()[0]
    moved = merged.select(F.col("node").alias("__l"), (F.col("component") + F.lit(offset)).alias("__to"))
    joined = labelled.join(moved, F.col("label") == F.col("__l"), "left")
    return compact(joined.withColumn("label", F.coalesce("__to", "label")).drop("__l", "__to"))


def cut_bridges(points: DataFrame, p: Split, by: list[str]) -> DataFrame:
    """Adds ``bridge``: sparse points between dense parts of each group, unless cutting them leaves too little of it."""
    counted = has_near(points, p.density_radius, p.min_neighbours, by, "__dense")
    sizes = counted.groupBy(*by).agg(F.count("*").alias("__n"), F.sum(F.col("__dense").cast("long")).alias("__kept"))
    enough = (F.col("__kept") >= p.min_remain_points) & (F.col("__kept") / F.col("__n") >= p.min_remain_fraction)
    joined = counted.join(sizes.select(*by, enough.alias("__cut")), by)
    return joined.withColumn("bridge", F.col("__cut") & ~F.col("__dense")).drop("__dense", "__cut")


def split_clusters(labelled: DataFrame, p: Split, base_eps: float) -> DataFrame:
    """Splits big clusters at sparse bridges and adds ``part`` and ``removed``.

    Each big cluster loses its bridges, is clustered again with a smaller radius, and is
    split if at least two parts are large enough. ``part`` numbers its parts from 0; it
    is 0 in clusters that stay whole, and null for the points that a split drops: noise,
    small parts and bridges, of which only the last have ``removed``.
    """
    big = boxes(labelled.where("label >= 0")).where(is_big(p)).select("label")
    inside = cut(labelled.join(big, "label", "left_semi"))
    bridged = cut(cut_bridges(inside.select("point_id", "label", *G.XYZ), p, ["label"]))
    eps = max(p.sub_eps_min, base_eps * p.sub_eps_ratio)
    parts = dbscan(bridged.where("not bridge"), eps, p.sub_min_points, ["label"], numbered=False).select("point_id", "label", "cluster")
    parts = cut(parts.where("cluster is not null"))
    sizes = parts.groupBy("label", "cluster").count().where(F.col("count") >= p.min_sub_cluster)
    several = sizes.groupBy("label").agg(F.count("*").alias("n_parts")).where("n_parts >= 2").select("label")
    ranked = cut(sizes.join(several, "label").select("label", "cluster"))
    ranked = number_rows(ranked, ["label"], ["cluster"], "part").withColumn("part", (F.col("part") - 1).cast("int"))
    of_point = parts.join(ranked, ["label", "cluster"]).select(F.col("point_id").alias("__id"), F.col("part").alias("__part"))
    bridges = bridged.where("bridge").select(F.col("point_id").alias("__b"))
    was_split = ranked.select(F.col("label").alias("__s")).distinct()
    joined = labelled.join(of_point, F.col("point_id") == F.col("__id"), "left").join(bridges, F.col("point_id") == F.col("__b"), "left")
    joined = joined.join(was_split, F.col("label") == F.col("__s"), "left")
    whole = F.col("__s").isNull()
    out = joined.withColumn("part", F.when(whole, F.lit(0)).otherwise(F.col("__part")))
    return out.withColumn("removed", ~whole & F.col("__b").isNotNull()).drop("__id", "__part", "__b", "__s")


def floor_height(points: DataFrame, p: Structure) -> float | None:
    """The exact percentile of the height axis, from below or above; null without points."""
    share = p.floor_percentile / 100 if p.floor_side == "min" else 1 - p.floor_percentile / 100
    return percentiles(points, p.height_axis, {"at": share}).first()["at"]


def floating_clusters(points: DataFrame, p: Structure, floor: float) -> DataFrame:
    """Adds ``label`` of a temporary clustering and ``floating``: small clusters well above the floor. Noise stays."""
    labelled = cut(dbscan(points, p.float_eps, p.float_min_points).drop("core", "cluster"))
    gap = F.col(f"min{p.height_axis}") - F.lit(floor) if p.floor_side == "min" else F.lit(floor) - F.col(f"max{p.height_axis}")
    table = boxes(labelled.where("label >= 0"))
    small = (gap >= p.float_gap) & (F.col("n") <= p.float_max_points) & (F.greatest("extentx", "extenty", "extentz") <= p.float_max_extent)
    gone = table.where(small).select(F.col("label").alias("__f"))
    joined = labelled.join(gone, F.col("label") == F.col("__f"), "left")
    return joined.withColumn("floating", F.col("__f").isNotNull()).drop("__f")
