"""Neighbour joins over grid buckets.

A point within a radius is in one of the 27 cells around, so each join is an equi-join
on cells with the distance as a residual filter. Points at the same place are joined
once, with their number, so that copies of a point do not multiply.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pointloom.functions import geometry as G
from pointloom.plans.lineage import cut

_CELL = ("__cx", "__cy", "__cz")


def _cells(df: DataFrame, size: float, prefix: str = "") -> DataFrame:
    return df.withColumns({k: G.cell(F.col(prefix + c), F.lit(0.0), size) for k, c in zip(_CELL, G.XYZ, strict=True)})


def _around(df: DataFrame, reach: int = 1) -> DataFrame:
    """Each row in all cells up to ``reach`` away from its own."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    for k in _CELL:
        df = df.withColumn("__d", F.explode(steps)).withColumn(k, F.col(k) + F.col("__d")).drop("__d")
    return df


def _places(points: DataFrame, prefix: str, keys: Sequence[str], *values: Column) -> DataFrame:
    """Distinct places (within ``keys``), their coordinates prefixed, with aggregated ``values``."""
    named = points.where(" and ".join(f"{c} is not null" for c in G.XYZ))
    return named.groupBy(*keys, *(F.col(c).alias(prefix + c) for c in G.XYZ)).agg(*values)


def near_places(left: DataFrame, right: DataFrame, radius: float, keys: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Pairs of places within ``radius`` (``strict``: nearer), with columns l* and r*, their values and ``d2``."""
    at = _around(_cells(left, radius, "l"))
    met = at.join(_cells(right, radius, "r"), [*keys, *_CELL])
    d2 = G.squared_distance(G.columns(G.XYZ, "l"), G.columns(G.XYZ, "r"))
    limit = F.lit(float(radius) * float(radius))
    pairs = met.withColumn("d2", d2)
    return pairs.where(F.col("d2") < limit if strict else F.col("d2") <= limit).drop(*_CELL)


#: A place first looks around in the finest cell that holds a fourth of the places it wants, itself included, so that it likely
#: finds all of them; so many levels of cells are counted at once.
_SHARE, _LEVELS = 4, 8


def _first_levels(places: DataFrame, radius: float, least: int) -> tuple[DataFrame, list[int]]:
    """Places r* with ``level``, how often ``radius`` may be halved so that their cell still holds ``least`` places, and all levels, finest first."""
    at = [f"r{c}" for c in G.XYZ]
    done, open_, base = [], places.select(*at).withColumn("level", F.lit(0)), 0
    while True:
        steps = F.explode(F.array(*(F.lit(base + i) for i in range(1, _LEVELS + 1)))).alias("__l")
        cells = [F.floor(F.col(c) / (F.lit(float(radius)) / F.pow(F.lit(2.0), F.col("__l")))).alias(k) for c, k in zip(at, _CELL, strict=True)]
        spread = open_.select(*at, "level", steps).select("*", *cells)
        full = spread.groupBy("__l", *_CELL).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n")
        deepest = spread.join(full, ["__l", *_CELL]).groupBy(*at).agg(F.max("__l").alias("__d"))
        levelled = cut(open_.join(deepest, at, "left").select(*at, F.coalesce("__d", "level").alias("level")))
        base += _LEVELS
        done.append(levelled.where(F.col("level") < base))
        open_ = levelled.where(F.col("level") == base)
        if not open_.limit(1).count():
            break
    table = done[0]
    for d in done[1:]:
        table = table.unionByName(d)
    return table, sorted((r.level for r in table.select("level").distinct().collect()), reverse=True)


def over_nearest(places: DataFrame, most: int, radius: float, *values: Column) -> DataFrame:
    """``values``, and the number ``n``, aggregated over the at most ``most`` nearest places within ``radius`` of each place, itself included.

    Of distinct ``places`` r*; rows have l*. Among equally near ones those of the least coordinates
    count. A place starts with a radius that fits how dense its surroundings are, and doubles it
    until ``most`` places lie within, so not all pairs within ``radius`` are made. Few places of a
    cell are open at a time: those with few places in a cell half as wide, and those with less than
    ``most`` within half the radius. So each place is met a bounded number of times a level.
    """
    at = [f"l{c}" for c in G.XYZ]
    levelled, levels = _first_levels(places, radius, max(2, most // _SHARE))
    first = levelled.select(*(F.col(f"r{c}").alias(f"l{c}") for c in G.XYZ), "level")
    done: list[DataFrame] = []
    left: DataFrame | None = None
    for level in range(max(levels, default=0), -1, -1):
        if level and left is None and level not in levels:
            continue
        open_ = first.where(F.col("level") == level).select(*at)
        open_ = open_ if left is None else open_.unionByName(left)
        nth = F.row_number().over(Window.partitionBy(*at).orderBy("d2", "rx", "ry", "rz"))
        near = near_places(open_, places, radius / 2**level).withColumn("__k", nth).where(F.col("__k") <= most)
        found = cut(near.groupBy(*at).agg(F.count("*").alias("n"), *values))
        left = None
        if level:
            short = found.where(F.col("n") < most).select(*at)
            left = short if short.limit(1).count() else None
            found = found.where(F.col("n") == most)
        done.append(found)
    table = done[0]
    for d in done[1:]:
        table = table.unionByName(d)
    return table


def _at_places(points: DataFrame, table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``points`` left-joined to a table of places with columns lx, ly, lz."""
    on = [F.col(f"p.{k}") == F.col(f"t.{k}") for k in keys] + [F.col(f"p.{c}") == F.col(f"t.l{c}") for c in G.XYZ]
    condition = on[0]
    for o in on[1:]:
        condition = condition & o
    drop = [F.col(f"t.{k}") for k in keys] + [F.col(f"t.l{c}") for c in G.XYZ]
    return points.alias("p").join(table.alias("t"), condition, "left").drop(*drop)


def radius_count(points: DataFrame, radius: float, keys: Sequence[str] = (), name: str = "n_near", of: DataFrame | None = None) -> DataFrame:
    """Adds the number of points (of the same ``keys``) within ``radius``, the point itself included; null without a place.

    With ``of``, the points of that cloud are counted instead, and only those of ``points`` are looked around.
    """
    n = F.count("*")
    left = _places(points, "l", keys, n.alias("__own"))
    right = _places(points if of is None else of, "r", keys, n.alias("__n"))
    pairs = near_places(left.drop("__own"), right, radius, keys)
    counts = pairs.groupBy(*keys, "lx", "ly", "lz").agg(F.sum("__n").alias(name))
    return _at_places(points, counts, keys)


def crowded(places: DataFrame, radius: float, least: int, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``crowded`` to places (r*, ``n`` points each): whether at least ``least`` points lie within ``radius``, their own included.

    All points of a cell whose diagonal is below the radius are near each other, so where such a
    cell has enough points nothing is joined. Only places of sparse cells meet their neighbours;
    as they are few in a cell, a dense cell is met a bounded number of times for each ``least``.
    """
    fine = [F.floor(F.col(f"r{c}") / F.lit(radius / math.sqrt(3) * 0.999)).alias(f"__f{c}") for c in G.XYZ]
    cells = places.groupBy(*keys, *fine).agg((F.sum("n") >= least).alias("__full")).where("__full")
    named = places.withColumns({f"__f{c}": f for c, f in zip(G.XYZ, fine, strict=True)})
    on = [*keys, *(f"__f{c}" for c in G.XYZ)]
    marked = cut(named.join(cells, on, "left").drop(*(f"__f{c}" for c in G.XYZ)))
    left = marked.where("__full is null").select(*keys, *(F.col(f"r{c}").alias(f"l{c}") for c in G.XYZ))
    near = near_places(left, places.select(*keys, *(f"r{c}" for c in G.XYZ), "n"), radius, keys)
    counts = near.groupBy(*keys, *(F.col(f"l{c}").alias(f"r{c}") for c in G.XYZ)).agg((F.sum("n") >= least).alias("__near"))
    joined = marked.join(counts, [*keys, *(f"r{c}" for c in G.XYZ)], "left")
    return joined.withColumn("crowded", F.coalesce("__full", "__near")).drop("__full", "__near")


def has_near(points: DataFrame, radius: float, least: int, keys: Sequence[str] = (), name: str = "dense") -> DataFrame:
    """Adds whether at least ``least`` points (of the same ``keys``) lie within ``radius``, itself included; null without a place."""
    table = crowded(_places(points, "r", keys, F.count("*").alias("n")), radius, least, keys)
    return _at_places(points, table.select(*keys, *(F.col(f"r{c}").alias(f"l{c}") for c in G.XYZ), F.col("crowded").alias(name)), keys)


def radius_outliers(points: DataFrame, radius: float, nb_points: int) -> DataFrame:
    """Adds ``keep``: whether over ``nb_points`` points, itself included, lie within ``radius``."""
    return has_near(points, radius, nb_points + 1, (), "keep")


def near_distance(points: DataFrame, target: DataFrame, radius: float, name: str = "distance") -> DataFrame:
    """Adds the distance to the nearest target point, null where none lies within ``radius``."""
    left = points.select(*(F.col(c).alias(f"l{c}") for c in G.XYZ)).dropna().distinct()
    right = target.select(*(F.col(c).alias(f"r{c}") for c in G.XYZ)).dropna().distinct()
    least = near_places(left, right, radius).groupBy("lx", "ly", "lz").agg(F.sqrt(F.min("d2")).alias(name))
    return _at_places(points, least)


def remove_near(points: DataFrame, target: DataFrame, radius: float) -> DataFrame:
    """The points with no target point within ``radius``: strictly further ones stay, and those without a place."""
    near = near_distance(points, target, radius, "__d")
    return near.where("__d is null").drop("__d")


#: Rings that ``nearest`` searches before it descends a pyramid of cells for the places that are left.
RINGS = 3
#: Cells of the top of the pyramid, at most; each place that is left is held against all of them.
TOP_CELLS = 64


def _gap2(far: bool) -> Column:
    """The least (``far``: greatest) squared distance of a place l* to the box lo*, hi* of a cell."""
    out = F.lit(0.0)
    for c in G.XYZ:
        below, above = F.col(f"lo{c}") - F.col(f"l{c}"), F.col(f"l{c}") - F.col(f"hi{c}")
        step = F.greatest(F.abs(below), F.abs(above)) if far else F.greatest(below, above, F.lit(0.0))
        out = out + step * step
    return out


def _levels(goal: DataFrame, size: float) -> list[DataFrame]:
    """Occupied cells with the boxes of their places, finest first; each level has half as many cells to a side."""
    ends = lambda low, high: [f(x).alias(a + c) for c in G.XYZ for f, x, a in ((F.min, low + c, "lo"), (F.max, high + c, "hi"))]
    cells = [F.floor(F.col(f"r{c}") / F.lit(size)).alias(k) for c, k in zip(G.XYZ, _CELL, strict=True)]
    out = [cut(goal.groupBy(*cells).agg(*ends("r", "r")))]
    while out[-1].count() > TOP_CELLS:
        upper = [F.shiftright(k, 1).alias(k) for k in _CELL]
        out.append(cut(out[-1].groupBy(*upper).agg(*ends("lo", "hi"))))
    return out


def _descended(places: DataFrame, goal: DataFrame, size: float) -> DataFrame:
    """The nearest of ``goal`` to places l* that may be far from all of it, as ``nearest`` finds it.

    From the top of a pyramid of occupied cells down, a place keeps the cells that may be nearer
    than the farthest point of some cell, so it meets the targets of few cells, not all.
    """
    at, box = [f"l{c}" for c in G.XYZ], [f"{a}{c}" for c in G.XYZ for a in ("lo", "hi")]
    levels = _levels(goal, size)
    top = [r.asDict() for r in levels[-1].collect()]  # at most TOP_CELLS rows
    cells = F.array(*(F.struct(*(F.lit(r[k]).alias(k) for k in (*_CELL, *box))) for r in top))
    open_ = places.select(*at, F.explode(cells).alias("c")).select(*at, "c.*")
    for level in [None, *levels[-2::-1]]:
        if level is not None:
            inside = level.groupBy(*(F.shiftright(k, 1).alias(f"__p{k}") for k in _CELL)).agg(F.collect_list(F.struct(*_CELL, *box)).alias("c"))
            on = [F.col(k) == F.col(f"__p{k}") for k in _CELL]
            open_ = open_.join(inside, on[0] & on[1] & on[2]).select(*at, F.explode("c").alias("c")).select(*at, "c.*")
        bound = open_.groupBy(*at).agg(F.min(_gap2(True)).alias("__most"))
        open_ = cut(open_.join(bound, at).where(_gap2(False) <= F.col("__most") * (1 + 1e-12)).drop("__most"))
    targets = goal.withColumns({k: F.floor(F.col(f"r{c}") / F.lit(size)) for c, k in zip(G.XYZ, _CELL, strict=True)})
    met = open_.select(*at, *_CELL).join(targets, list(_CELL))
    d2 = G.squared_distance(G.columns(G.XYZ, "l"), G.columns(G.XYZ, "r"))
    return met.groupBy(*at).agg(F.min(F.struct(d2.alias("d2"), "__v")).alias("__b"))


def nearest(points: DataFrame, target: DataFrame, values: Sequence[str] = (), key: str = "point_id", first_radius: float | None = None) -> DataFrame:
    """Adds ``distance`` to the nearest target point and its ``values``; among equally near ones the least ``key``.

    A few rings are searched outwards: a place is done once its nearest candidate lies within
    the radius of its ring, the rest goes on with twice the radius. The first radius follows from
    the target's density. Places that are left are far from all targets and descend a pyramid of
    cells instead. Null everywhere if the target is empty.
    """
    spots = cut(points.select(*(F.col(c).alias(f"l{c}") for c in G.XYZ)).dropna().distinct())
    best = F.min(F.struct(key, *values)).alias("__v")
    goal = cut(_places(target, "r", (), best))
    bounds = goal.agg(F.count("*").alias("n"), *(f(f"r{c}").alias(f"{a}{c}") for c in G.XYZ for f, a in ((F.min, "lo"), (F.max, "hi")))).first()
    if not bounds.n:
        nothing = [F.lit(None).cast(target.schema[v].dataType).alias(v) for v in values]
        return points.select("*", F.lit(None).cast("double").alias("distance"), *nothing)
    reach = 1.001 * math.sqrt(sum((bounds[f"hi{c}"] - bounds[f"lo{c}"]) ** 2 for c in G.XYZ)) + 1e-9
    radius = first_radius or max(reach / max(bounds.n ** (1 / 3), 1.0), 1e-9)
    done: list[DataFrame] = []
    open_, size = spots, radius
    for _ in range(RINGS):
        pairs = near_places(open_, goal, radius)
        found = cut(pairs.groupBy("lx", "ly", "lz").agg(F.min(F.struct("d2", "__v")).alias("__b")))
        done.append(found)
        open_ = cut(open_.join(found, ["lx", "ly", "lz"], "left_anti"))
        if not open_.limit(1).count():
            break
        radius *= 2
    else:
        done.append(_descended(open_, goal, size))
    table = done[0]
    for d in done[1:]:
        table = table.unionByName(d)
    table = table.select("lx", "ly", "lz", F.sqrt("__b.d2").alias("distance"), *(F.col(f"__b.__v.{v}").alias(f"__t_{v}") for v in values))
    joined = _at_places(points, table)
    keep = [F.col(c) for c in points.columns if c not in values]
    return joined.select(*keep, "distance", *(F.col(f"__t_{v}").alias(v) for v in values))


def transfer_colours(points: DataFrame, source: DataFrame, fallback: Sequence[float] = (0.7, 0.7, 0.7)) -> DataFrame:
    """Colours each point as its nearest source point; ``fallback`` where there is none or it has no colour."""
    got = nearest(points.drop(*G.RGB), source, G.RGB).drop("distance")
    return got.withColumns({c: F.coalesce(F.col(c), F.lit(float(v))) for c, v in zip(G.RGB, fallback, strict=True)})
