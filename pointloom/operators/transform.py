"""Projections of points: rigid transforms, colours, selections and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pointloom.functions import geometry as G
from pointloom.plans.scalars import one_row

GREY = 0.6
PALETTE_SEED = 0


@dataclass(frozen=True)
class Alignment:
    """A rigid transform: the centroid taken off, then a rotation."""

    centroid: tuple[float, float, float]
    rotation: tuple[tuple[float, float, float], ...]


def _replaced(df: DataFrame, names: Sequence[str], values: Sequence[Column]) -> DataFrame:
    return df.withColumns(dict(zip(names, values, strict=True)))


def _has(df: DataFrame, names: Sequence[str]) -> bool:
    return set(names) <= set(df.columns)


def align(points: DataFrame, a: Alignment) -> DataFrame:
    """(p - centroid) rotated; normals, if there are any, are rotated only. Other columns stay."""
    moved = G.minus(G.columns(G.XYZ), [F.lit(float(c)) for c in a.centroid])
    out = _replaced(points, G.XYZ, G.rotated(moved, a.rotation))
    return _replaced(out, G.NORMAL, G.rotated(G.columns(G.NORMAL), a.rotation)) if _has(points, G.NORMAL) else out


def unalign(points: DataFrame, a: Alignment) -> DataFrame:
    """The inverse of ``align`` for an orthonormal rotation; normals are rotated back."""
    back = G.transposed(a.rotation)
    turned = G.rotated(G.columns(G.XYZ), back)
    out = _replaced(points, G.XYZ, [v + F.lit(float(c)) for v, c in zip(turned, a.centroid, strict=True)])
    return _replaced(out, G.NORMAL, G.rotated(G.columns(G.NORMAL), back)) if _has(points, G.NORMAL) else out


def with_colours(points: DataFrame, fallback: Sequence[float] = (GREY, GREY, GREY)) -> DataFrame:
    """Fills missing colours with ``fallback``."""
    if not _has(points, G.RGB):
        return paint(points, fallback)
    return _replaced(points, G.RGB, [F.coalesce(F.col(c), F.lit(float(v))) for c, v in zip(G.RGB, fallback, strict=True)])


def paint(points: DataFrame, colour: Sequence[float]) -> DataFrame:
    return _replaced(points, G.RGB, [F.lit(float(v)) for v in colour])


def palette(labels: Sequence[int], seed: int = PALETTE_SEED) -> np.ndarray:
    """Row ``label`` of the seeded table of random colours, whatever the table's length."""
    out = np.empty((len(labels), 3))
    for i, label in enumerate(labels):
        stream = np.random.PCG64(seed)
        stream.advance(3 * int(label))
        out[i] = np.random.Generator(stream).random(3)
    return out


def colour_labels(points: DataFrame, label: str = "label", noise: float = 0.2, all_noise: float = 0.5) -> DataFrame:
    """Colours points by label; noise (a negative or null label) is ``noise`` grey, or ``all_noise`` if no label is positive.

    Colours are made from the label alone, a distinct label of a batch at a time.
    """

    @F.pandas_udf("struct<r:double,g:double,b:double>")
    def colour(labels: pd.Series) -> pd.DataFrame:
        known = labels.fillna(-1).astype("int64")
        codes, distinct = pd.factorize(known)
        table = palette([max(int(v), 0) for v in distinct])
        return pd.DataFrame(table[codes], columns=list(G.RGB))

    any_label = one_row(points.agg(F.max(F.col(label) >= 0).alias("any")))["any"]
    grey = F.when(F.coalesce(any_label, F.lit(False)), F.lit(noise)).otherwise(F.lit(all_noise))
    joined = points.withColumn("__grey", grey).withColumn("__c", colour(F.col(label)))
    named = F.col(label) >= 0
    out = _replaced(joined, G.RGB, [F.when(named, F.col(f"__c.{c}")).otherwise(F.col("__grey")) for c in G.RGB])
    return out.drop("__grey", "__c")


def quantise_colours(points: DataFrame, levels: int) -> DataFrame:
    """Adds qr, qg, qb and the material's name and colour."""
    keys = [G.quantised(F.col(c), levels) for c in G.RGB]
    out = points.withColumns(dict(zip(("qr", "qg", "qb"), keys, strict=True)))
    return out.withColumn("material", G.material_name(G.columns(("qr", "qg", "qb"))))


def byte_colours(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Colours as 0 to 255, times 255 only where no channel of the cloud (of each group of ``by``) is over 1."""
    most = F.max(F.greatest(*G.RGB)).alias("__most")
    if by:
        joined = points.join(points.groupBy(*by).agg(most), list(by), "left")
    else:
        joined = points.withColumn("__most", one_row(points.agg(most))["__most"])
    out = _replaced(joined, G.RGB, [G.byte_channel(F.col(c), F.col("__most") <= 1.0) for c in G.RGB])
    return out.select(*points.columns)


def select_by_id(points: DataFrame, ids: DataFrame, invert: bool = False, key: str = "point_id") -> DataFrame:
    """The points whose id is (with ``invert``: is not) among ``ids``; by id, never by position."""
    return points.join(ids.select(key).distinct(), key, "left_anti" if invert else "left_semi")


def crop(points: DataFrame, low: Sequence[float], high: Sequence[float], margin: float = 0.0) -> DataFrame:
    """The points within a box widened by ``margin``, borders included. The range reaches the scan as a filter."""
    keep = F.lit(True)
    for c, lo, hi in zip(G.XYZ, low, high, strict=True):
        keep = keep & F.col(c).between(lo - margin, hi + margin)
    return points.where(keep)


def concat(*parts: DataFrame) -> DataFrame:
    """Clouds, line sets or meshes one after the other; columns that one lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def difference(points: DataFrame, kept: DataFrame, key: str = "point_id") -> DataFrame:
    """What ``kept`` has lost of ``points``."""
    return select_by_id(points, kept, invert=True, key=key)


def _brought(points: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregates of each group, or of all points, beside the points."""
    return points.join(table, keys) if keys else points.withColumn("__row", one_row(table)).select("*", "__row.*").drop("__row")


def normalise(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Centres each group on its mean and scales it to a largest norm of 1 (left alone up to 1e-8)."""
    keys = list(by)
    means = points.groupBy(*keys).agg(*(F.avg(c).alias(f"__m{c}") for c in G.XYZ))
    joined = _brought(points, means, keys)
    centred = _replaced(joined, G.XYZ, [F.col(c) - F.col(f"__m{c}") for c in G.XYZ]).select(*points.columns)
    reach = centred.groupBy(*keys).agg(F.max(G.norm(G.columns(G.XYZ))).alias("__reach"))
    joined = _brought(centred, reach, keys)
    scale = F.when(F.col("__reach") > 1e-8, F.col("__reach")).otherwise(F.lit(1.0))
    return _replaced(joined, G.XYZ, [F.col(c) / scale for c in G.XYZ]).select(*points.columns)
