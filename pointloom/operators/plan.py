"""Room plans: areas, perimeters and checks of walls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def polygon_area(corners: DataFrame, by: str, order: str) -> DataFrame:
    """(by, area, perimeter, corners): shoelace formula over corners x, y in their order, closed by the first one."""
    path = Window.partitionBy(by).orderBy(order)
    whole = path.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = {c: F.coalesce(F.lead(c).over(path), F.first(c).over(whole)) for c in ("x", "y")}
    steps = corners.withColumns({"__x": following["x"], "__y": following["y"]})
    twice = F.sum(F.col("x") * F.col("__y") - F.col("__x") * F.col("y"))
    length = F.sqrt((F.col("__x") - F.col("x")) * (F.col("__x") - F.col("x")) + (F.col("__y") - F.col("y")) * (F.col("__y") - F.col("y")))
    return steps.groupBy(by).agg((F.abs(twice) / 2).alias("area"), F.sum(length).alias("perimeter"), F.count("*").alias("corners"))


def _turn(a: Column, b: Column) -> Column:
    """Difference of two angles in degrees, 0 to 180."""
    d = F.abs(a - b) % 360
    return F.least(d, 360 - d)


def wall_checks(walls: DataFrame, width: float = 0.0015, area: float = 0.003, angle: float = 0.1, joint: float = 0.001) -> DataFrame:
    """Whether each wall's width, area and angle follow from its ends, and whether it begins where the last one ends."""
    path = Window.partitionBy("plan").orderBy("wall_id")
    whole = path.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    last_x = F.coalesce(F.lag("x1").over(path), F.last("x1").over(whole))
    last_y = F.coalesce(F.lag("y1").over(path), F.last("y1").over(whole))
    return walls.select(
        "plan",
        "wall_id",
        (F.abs(F.sqrt(dx * dx + dy * dy) - F.col("width_m")) <= width).alias("width_ok"),
        (F.abs(F.col("width_m") * F.col("height_m") - F.col("area_m2")) <= area).alias("area_ok"),
        (_turn(F.degrees(F.atan2(dy, dx)), F.col("angle_deg")) <= angle).alias("angle_ok"),
        ((F.abs(F.col("x0") - last_x) <= joint) & (F.abs(F.col("y0") - last_y) <= joint)).alias("closed_ok"),
    )


def plan_checks(summaries: DataFrame, walls: DataFrame, area: float = 0.005, volume: float = 0.01) -> DataFrame:
    """Whether a plan's area and volume follow from its walls and height."""
    corners = walls.select("plan", "wall_id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    shapes = polygon_area(corners, "plan", "wall_id")
    joined = summaries.join(shapes, "plan")
    return joined.select(
        "plan",
        F.col("area").alias("shoelace_m2"),
        (F.abs(F.col("area") - F.col("floor_area_m2")) <= area).alias("area_ok"),
        (F.abs(F.col("floor_area_m2") * F.col("room_height_m") - F.col("volume_m3")) <= volume).alias("volume_ok"),
        (F.col("corners") == F.col("num_corners")).alias("corners_ok"),
    )
