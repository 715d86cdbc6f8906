"""Joining large tables when a few keys hold many of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Keys that hold more than one row in SLOTS at least are hot; with many partitions, those that hold more than one's share.
SLOTS = 1000
#: No more slots than this, so that a table of hot keys can be broadcast.
MOST_SLOTS = 100_000
#: A set of keys of at most so many rows, counted first, is broadcast; a larger one is shuffled.
FEW_KEYS = 1 << 20


def slots_for(df: DataFrame) -> int:
    """One slot for each shuffle partition, so that what is not hot fits a task however many tasks there are."""
    return min(max(SLOTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_SLOTS)


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    weight: str,
    total: int | Column,
    slots: int | None = None,
    how: str = "left",
    nulls: bool = True,
) -> DataFrame:
    """Join ``rows`` to ``table`` (one row per key) without sending a hot key to one task.

    ``weight`` is the column of ``table`` with the number of ``rows`` of its key and
    ``total`` the number of all rows. Fewer than ``slots`` keys (by default at least
    the number of partitions, at most MOST_SLOTS) can hold more than ``total / slots`` rows
    each, so the hot part of ``table`` has a proven size bound and is broadcast; all other
    keys are small and meet in a shuffled join. Null keys match null keys, unless ``nulls``
    says that there are none to match: plain equality of numbers takes the driver less memory
    to broadcast. ``weight`` is not in the result. ``how`` is "left", or "inner" to leave out
    rows whose key is not in ``table``.
    """
    table = table.withColumnRenamed(key, "__key").withColumnRenamed(weight, "__n")
    hot = F.col("__n") * F.lit(slots or slots_for(rows)) > total
    match = F.col(key).eqNullSafe(F.col("__key")) if nulls else F.col(key) == F.col("__key")
    hot_table = F.broadcast(table.where(hot))
    spread = rows.join(hot_table, match, "inner").drop("__key", "__n")
    rest = rows.join(F.broadcast(table.where(hot).select("__key")), match, "left_anti")
    return spread.unionByName(rest.join(table.where(~hot), match, how).drop("__key", "__n"))


def without(rows: DataFrame, gone: DataFrame, key: str, few: int = FEW_KEYS) -> DataFrame:
    """The ``rows`` whose ``key`` is not among those of ``gone``, which are distinct and not null.

    Up to ``few`` keys are broadcast, after counting them, so that no row is moved; more are joined.
    """
    keys = gone.select(key)
    return rows.join(F.broadcast(keys) if keys.count() <= few else keys, key, "left_anti")


def among(rows: DataFrame, wanted: DataFrame, key: str, few: int = FEW_KEYS) -> DataFrame:
    """The ``rows`` whose ``key`` is among those of ``wanted``; see ``without``."""
    keys = wanted.select(key)
    return rows.join(F.broadcast(keys) if keys.count() <= few else keys, key, "left_semi")
