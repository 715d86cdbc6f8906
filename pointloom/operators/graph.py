"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from pointloom.plans.lineage import cut
from pointloom.plans.skew import lookup_join


#: So many edges, of 16 bytes, fit a task even if all are one hub's.
TASK_EDGES = 1 << 20


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Adds to each edge ``m``, the least of ``u`` and its neighbours ``v``; a large hub's edges are not gathered in one task."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    if total <= TASK_EDGES:
        return edges.join(least.drop("n").withColumnRenamed("u", "__u"), F.col("u") == F.col("__u")).drop("__u")
    return lookup_join(edges, least, "u", "n", total, nulls=False)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _with_least(both, 2 * total)
    return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` point downwards (u > v), as the large star leaves them, no more than ``total`` of them."""
    linked = _with_least(edges, total)
    down = linked.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = edges.groupBy("u").agg(F.min("v").alias("v"))
    return down.unionByName(own).distinct()


def _cut_counted(edges: DataFrame) -> tuple[DataFrame, tuple[int, object]]:
    """``edges`` cut, with their number and a checksum, both observed while they are written."""
    seen = Observation()
    checksum = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("checksum")
    done = cut(edges.observe(seen, F.count("*").alias("n"), checksum))
    return done, (seen.get["n"], seen.get["checksum"])


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Return (node, component) for every node of ``edges``; component is the least node reachable.

    Edges are undirected; self-loops, repeats and nulls are allowed (a null end is
    dropped, a node seen only in a self-loop is its own component). Each round is a
    handful of shuffles of the edge list, none where it fits a task; nothing is collected but a number and a checksum.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna()
    down = ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    loops = ends.where("u = v").select(F.col("u").alias("node")).distinct()
    current, state = _cut_counted(down)
    if state[0] <= TASK_EDGES:
        current = current.coalesce(1)  # one task then does all rounds, without a shuffle
    while state[0]:
        before = state
        current, state = _cut_counted(_small_star(_large_star(current, state[0]), state[0]))
        if state == before:
            break
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    known = current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    alone = loops.join(known, "node", "left_anti").select("node", F.col("node").alias("component"))
    return known.unionByName(alone).distinct()
