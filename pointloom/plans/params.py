"""Parameter sets of the pipelines (fixed values, in metres and points)."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class DbscanAuto:
    """How the neighbourhood radius is shrunk until the largest cluster is small enough.

    ``stop_at_floor``: a radius that has reached ``eps_min`` is not tried any more.
    """

    eps: float
    min_points: int
    max_fraction: float
    shrink: float
    retries: int
    eps_min: float
    stop_at_floor: bool = False


@dataclass(frozen=True)
class BoxFilter:
    """Limits below which a box is debris: size, thinness and elongation."""

    min_points: int
    min_size: float
    thin_min: float
    thin_keep_footprint: float
    elong_ratio: float
    elong_remove_footprint: float


@dataclass(frozen=True)
class Merge:
    distance: float = 0.06
    min_points: int = 80


@dataclass(frozen=True)
class Split:
    min_points: int = 2500
    max_extent: float = 1.20
    min_volume: float = 0.45
    density_radius: float = 0.10
    min_neighbours: int = 120
    min_remain_points: int = 300
    min_remain_fraction: float = 0.20
    sub_eps_ratio: float = 0.65
    sub_eps_min: float = 0.020
    sub_min_points: int = 20
    min_sub_cluster: int = 80


@dataclass(frozen=True)
class Structure:
    """Removing walls, floor and ceiling, outliers and floating clusters."""

    voxel: float = 0.02
    remove_radius: float = 0.08
    outlier_points: int = 200
    outlier_radius: float = 0.10
    height_axis: str = "y"
    floor_side: str = "min"
    floor_percentile: float = 1.0
    float_eps: float = 0.10
    float_min_points: int = 20
    float_gap: float = 0.25
    float_max_points: int = 1200
    float_max_extent: float = 0.45


@dataclass(frozen=True)
class Detect:
    clusters: DbscanAuto
    boxes: BoxFilter
    merge: Merge | None = None
    split: Split | None = None


@dataclass(frozen=True)
class Refine:
    crop_margin: float = 0.03
    far: float = 0.05
    sample: float = 0.025
    edge: float = 0.050
    area: float = 0.0010
    component: int = 100
    taubin_steps: int = 35
    taubin_lambda: float = 0.5
    taubin_mu: float = -0.53
    triangles: int = 30_000
    final_far: float = 0.030


@dataclass(frozen=True)
class Reconstruct:
    """Making a mesh of an object's points; ``max_edge`` and what follows only where the mesh is smoothed."""

    normal_radius: float
    normal_neighbours: int
    depth: int
    scale: float
    density_quantile: float
    vertex_distance: float
    triangles: int = 50_000
    max_edge: float | None = None
    centre_distance: float | None = None
    component: int | None = None
    taubin_steps: int | None = None
    orient_neighbours: int = 30
    min_points: int = 150
    crop_margin: float = 0.0


SMALL_BOXES = BoxFilter(120, 0.06, 0.015, 0.20, 15.0, 0.12)
BOXES = BoxFilter(150, 0.08, 0.02, 0.30, 12.0, 0.15)
DETECT_V1 = Detect(DbscanAuto(0.040, 25, 0.40, 0.85, 6, 0.025, True), SMALL_BOXES)
DETECT_V2 = Detect(DbscanAuto(0.055, 25, 0.45, 0.85, 6, 0.025, True), SMALL_BOXES, split=Split())
DETECT_FINAL = Detect(DbscanAuto(0.04, 30, 0.65, 0.85, 4, 0.03), BOXES)
DETECT_MERGED = replace(DETECT_FINAL, merge=Merge())
MESH = Reconstruct(0.08, 50, 8, 1.02, 0.08, 0.03)
MESH_SMOOTH = Reconstruct(0.12, 100, 7, 1.01, 0.15, 0.025, max_edge=0.06, centre_distance=0.025, component=100, taubin_steps=50, orient_neighbours=50)
STRUCTURE = Structure()
STRUCTURE_V1 = replace(STRUCTURE, outlier_points=150)
REFINE = Refine()
VOXEL_MESH_SIZE, COLOUR_LEVELS = 0.01, 8
