"""Numbering rows in order without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pointloom.plans.lineage import cut


def number_rows(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... within each group of ``by`` in the order of ``order``.

    Rows are range-partitioned by group and order, so a large group spans several
    tasks; each task numbers its own rows, and the numbers of a group's rows in the
    partitions before are added, which takes a row per group and partition.
    Equal rows are numbered in any order; nulls come first.
    """
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    seq = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = cut(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__seq", seq))
    spans = ranged.groupBy(*by, "__part").agg(F.min("__seq").alias("__from"), F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__from")).drop("__from", "__n")
    keys = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in [*by, "__part"]]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    spans = spans.select(*(F.col(c).alias(f"__k_{c}") for c in [*by, "__part"]), "__base")
    numbered = ranged.join(spans, on).withColumn(name, F.col("__base") + F.col("__seq") + 1)
    return numbered.select(*df.columns, name)


#: So many rows fit the sort of one task.
TASK_ROWS = 1 << 20


def ranks(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... over all rows in the order of ``order``, which tells them apart.

    Up to TASK_ROWS rows are put in order in one task, more by ranges.
    """
    df = cut(df)
    if df.count() <= TASK_ROWS:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    return number_rows(df.withColumn("__all", F.lit(0)), ["__all"], order, name).drop("__all")
