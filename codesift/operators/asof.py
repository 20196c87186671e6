"""Nearest point in time per key, without pairing all rows of a key.

Time is cut into cells and cells into blocks.  Inside a cell a running minimum
or maximum finds the nearest point; across the cells of a block one summary row
per cell is enough, across blocks one per block.  A key with very many rows is
spread over its cells, and its cells over their blocks, instead of filling one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def nearest(probes: DataFrame, points: DataFrame, keys: list[str], probe_time: str, point_time: str,
            forward: bool, cell_micros: int = 1_000_000, block_cells: int = 3600, value: str | None = None) -> DataFrame:
    """probes plus ``matched``: the nearest point time of the key, at or after (before) the probe.

    Both times are in microseconds; ``matched`` is null when there is none.  With ``value``, a long column of the
    points, it is the least (greatest) value of the points at or after (before) the probe instead.
    """
    carried = [c for c in probes.columns if c not in keys]
    union = probes.select(*keys, F.col(probe_time).alias("_t"), F.lit(None).cast("long").alias("_y"),
                          F.struct(*carried).alias("_row")).unionByName(
        points.select(*keys, F.col(point_time).alias("_t"), F.col(value or point_time).alias("_y")), allowMissingColumns=True)
    union = union.withColumn("_cell", F.floor(F.col("_t") / F.lit(cell_micros)))
    best, better, order = (F.min, F.least, F.desc) if forward else (F.max, F.greatest, F.asc)
    near = Window.partitionBy(*keys, "_cell").orderBy(order("_t")).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = union.withColumn("_local", best("_y").over(near)).filter("_row is not null")

    def beyond(*group: str, by: str):
        return Window.partitionBy(*group).orderBy(order(by)).rowsBetween(Window.unboundedPreceding, -1)

    cells = union.groupBy(*keys, "_cell").agg(best("_y").alias("_edge")).withColumn(
        "_block", F.floor(F.col("_cell") / F.lit(block_cells)))
    blocks = cells.groupBy(*keys, "_block").agg(best("_edge").alias("_edge")).select(
        *keys, "_block", best("_edge").over(beyond(*keys, by="_block")).alias("_far"))
    cells = cells.withColumn("_inside", best("_edge").over(beyond(*keys, "_block", by="_cell"))).join(
        blocks, [*keys, "_block"], "left").select(*keys, "_cell", better("_inside", "_far").alias("_far"))
    return local.join(cells, [*keys, "_cell"], "left").select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in probes.columns],
        better("_local", "_far").alias("matched"))
