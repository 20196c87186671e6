"""Gapless ranks inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def unit(h: Column) -> Column:
    """A 64-bit hash as a number in [0, 1)."""
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def ranked(df: DataFrame, group: list[str], cell: Column, order: list[Column], name: str) -> DataFrame:
    """df plus a 0-based rank of each row in its group; group columns must not be null.

    ``cell`` is a long: rows of a lower cell come first, inside a cell ``order`` decides.  A cell must fit a task
    and there must be far fewer cells than rows; the cells before one are added as one number.  The order must
    decide between all rows that differ.
    """
    df = df.withColumn("_cell", cell)
    count = df.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_many"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offset = count.select(*group, "_cell", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_cell").orderBy(*order)
    local = df.withColumn("_local", F.row_number().over(inside) - 1)
    return local.join(offset, [*group, "_cell"]).withColumn(name, F.col("_local") + F.col("_before")).drop(
        "_cell", "_local", "_before")
