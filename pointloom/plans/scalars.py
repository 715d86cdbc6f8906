"""One-row tables as scalars of a plan, so that no join is needed to bring them to the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def one_row(table: DataFrame) -> Column:
    """The only row of a table of aggregates as a struct: a subquery that runs once."""
    return table.select(F.struct(*table.columns).alias("row")).scalar()
