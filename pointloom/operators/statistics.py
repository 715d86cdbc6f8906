"""Summaries of clouds: match rates, bounds, percentiles and counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from pointloom.functions import geometry as G
from pointloom.plans.lineage import cut
from pointloom.plans.numbering import number_rows
from pointloom.plans.scalars import one_row


#: Up to so many values of a group are put in order within one aggregation.
TASK_VALUES = 1 << 20
#: More are first counted in so many bins a group, so that only the bins with the percentiles are put in order.
BINS = 4096


def percentiles(df: DataFrame, column: str, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles, interpolated between neighbours, by name: one row a group of ``by``, of its values that are not null.

    Without ``by`` there is always one row, of nulls if there are no values. Large groups are
    cut into bins of equal width; of the bins that a percentile falls into, the rows are numbered in
    order over several tasks. No task holds all values of a group.
    """
    x = F.col(column).cast("double")
    known = df.where(x.isNotNull() & ~F.isnan(x)).select(*by, x.alias("__x"))
    sizes = known.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    sizes = cut(sizes)
    if (sizes.agg(F.max("__n")).first()[0] or 0) <= TASK_VALUES:
        return known.groupBy(*by).agg(*(F.percentile("__x", F.lit(float(s))).alias(k) for k, s in shares.items()))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    others = lambda table: table.withColumnsRenamed({c: f"__b_{c}" for c in by})
    drop = [f"__b_{c}" for c in by]
    # One row a group: broadcast if the optimizer finds it small.
    binned = known.join(others(sizes), same).drop(*drop)
    width = F.when(F.col("__hi") > F.col("__lo"), (F.col("__hi") - F.col("__lo")) / BINS).otherwise(1.0)
    binned = binned.withColumn("__bin", F.least(F.floor((F.col("__x") - F.col("__lo")) / width), F.lit(BINS - 1)))
    counts = cut(binned.groupBy(*by, "__bin").agg(F.count("*").alias("__k"), F.first("__n").alias("__n")))
    upto = F.sum("__k").over(Window.partitionBy(*by).orderBy("__bin"))
    counts = counts.withColumn("__upto", upto)
    first, last = F.col("__upto") - F.col("__k"), F.col("__upto") - 1
    wanted = F.lit(False)
    for s in shares.values():
        at = (F.col("__n") - 1) * F.lit(float(s))
        wanted = wanted | ((first <= F.ceil(at)) & (last >= F.floor(at)))
    chosen = cut(counts.where(wanted).select(*by, "__bin", first.alias("__before")))
    near = same & (F.col("__bin") == F.col("__b_bin"))
    kept = binned.join(others(chosen).withColumnRenamed("__bin", "__b_bin"), near).drop(*drop, "__b_bin", "__lo", "__hi")
    placed = number_rows(kept, [*by, "__bin"], ["__x"], "__nth").withColumn("__at", F.col("__before") + F.col("__nth") - 1)
    out = []
    for k, s in shares.items():
        at = (F.col("__n") - 1) * F.lit(float(s))
        low, high = F.max(F.when(F.col("__at") == F.floor(at), F.col("__x"))), F.max(F.when(F.col("__at") == F.ceil(at), F.col("__x")))
        part = F.max(at - F.floor(at))
        out.append(F.when(part > 0, (1 - part) * low + part * high).otherwise(low).alias(k))
    return placed.groupBy(*by).agg(*out)


def match_rate(distances: DataFrame, radii: Sequence[float], column: str = "distance") -> DataFrame:
    """One row: mean, median, 90th and 95th percentile and the share within each radius; zeros without rows."""
    d = F.col(column)
    places = {"median": 0.5, "p90": 0.9, "p95": 0.95}
    ordered = one_row(percentiles(distances, column, places))
    shares = {f"within_{i}": F.avg((d <= F.lit(float(r))).cast("double")) for i, r in enumerate(radii)}
    made = distances.agg(F.avg(d).alias("mean"), *(v.alias(k) for k, v in shares.items()))
    values = {"mean": F.col("mean")} | {k: ordered[k] for k in places} | {k: F.col(k) for k in shares}
    return made.select(*(F.coalesce(v, F.lit(0.0)).alias(k) for k, v in values.items()))


def bounds(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Least, greatest and mean coordinates, of all points or of each group."""
    return points.groupBy(*by).agg(*(f(c).alias(a + c) for c in G.XYZ for f, a in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))), F.count("*").alias("n"))


def below_quantile(values: DataFrame, share: float, column: str = "density") -> DataFrame:
    """Adds ``low``: whether the value is below the exact quantile of all values."""
    edge = one_row(percentiles(values, column, {"q": share}))["q"]
    return values.withColumn("low", F.col(column) < edge)


def kept_and_removed(flagged: DataFrame, keep: str, by: Sequence[str] = ()) -> DataFrame:
    """How many rows a filter keeps and removes."""
    return flagged.groupBy(*by).agg(F.count("*").alias("before"), F.count(F.when(F.col(keep), 1)).alias("kept"), F.count(F.when(~F.col(keep), 1)).alias("removed"))
