"""Ranking of a whole frame without one task holding all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfledger.session import cut_lineage


def global_rank(
    df: DataFrame,
    order: list[Column],
    measure: str,
    rank: str = "sku_rank",
    running: str = "cumulative_revenue",
    total: str = "total_revenue",
    count: str = "sku_count",
) -> DataFrame:
    """Add rank, running sum, grand total and row count over the whole frame.

    ``order`` must be a total order.  The frame is range-partitioned on it, so
    rows of range i all precede rows of range i + 1; rank and running sum are
    then a window inside each range plus the offset of the ranges before it.
    The range number is stored by a checkpoint, so the offsets and the rows
    always speak of the same ranges.
    """
    ranged = cut_lineage(
        df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    )
    # One row per range: at most as many rows as shuffle partitions.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    offsets = (
        ranged.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_rows"), F.sum(measure).alias("_sum"))
        .select(
            "_range",
            F.nvl(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
            F.nvl(F.sum("_sum").over(before), F.lit(0.0)).alias("_sum_before"),
            F.sum("_rows").over(everything).alias(count),
            F.sum("_sum").over(everything).alias(total),
        )
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn(rank, F.col("_rows_before") + F.row_number().over(inside))
        .withColumn(
            running,
            F.col("_sum_before")
            + F.sum(measure).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .drop("_range", "_rows_before", "_sum_before")
    )
