"""Sell-through: what share of the available units was sold in a period."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from shelfledger.functions.columns import day_range, ratio, zero_if_null
from shelfledger.operators.stock import ITEM_COLUMNS, describe_products

MEASURES = ("begin_on_hand", "units_received", "units_sold")


def sell_through(
    snapshots: DataFrame,
    by_product: DataFrame,
    products: DataFrame,
    start: date,
    end: date,
    snapshot_days: list[date] | None = None,
) -> DataFrame:
    """Begin stock, received, sold and ratio per product.

    Begin and end stock come from the latest snapshot on or before each bound.  With
    ``snapshot_days``, the days that a lake lists, both are literals and exactly two day folders are opened; without,
    they are scalar subqueries over the day column of the whole table.  Stock and sales are stacked and
    summed once per product.
    """
    day = F.col("snapshot_date")

    def latest(bound: date):
        if snapshot_days is not None:
            return F.lit(max((d for d in snapshot_days if d <= bound), default=None)).cast("date")
        return snapshots.where(day <= F.lit(bound)).agg(F.max("snapshot_date")).scalar()

    begin_day, end_day = latest(start), latest(end)
    nothing = F.lit(0.0)
    stock = snapshots.where((day == begin_day) | (day == end_day)).select(
        "product_id",
        F.when(day == begin_day, F.col("quantity")).otherwise(nothing).alias("begin_on_hand"),
        F.when(day == end_day, F.col("quantity")).otherwise(nothing).alias("end_on_hand"),
        nothing.alias("units_sold"),
    )
    sold = by_product.where(day_range(F.col("date"), start, end)).select(
        "product_id",
        nothing.alias("begin_on_hand"),
        nothing.alias("end_on_hand"),
        zero_if_null(F.col("quantity")).alias("units_sold"),
    )
    totals = (
        stock.unionByName(sold)
        .groupBy("product_id")
        .agg(*[F.sum(name).alias(name) for name in ("begin_on_hand", "end_on_hand", "units_sold")])
    )
    received = F.greatest(
        F.col("end_on_hand") - F.col("begin_on_hand") + F.col("units_sold"), nothing
    )
    rated = totals.withColumn("units_received", received).withColumn(
        "sell_through",
        ratio(F.col("units_sold"), F.col("begin_on_hand") + F.col("units_received")),
    )
    return describe_products(rated, products).select(
        *ITEM_COLUMNS,
        "begin_on_hand",
        "units_received",
        F.col("units_received").alias("units_incoming"),
        *[
            nothing.alias(name)
            for name in (
                "units_production_in",
                "units_adjustment_net",
                "units_production_out",
                "units_transfer_net",
            )
        ],
        "units_sold",
        "sell_through",
    )


def _with_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "sell_through",
        ratio(F.col("units_sold"), F.col("begin_on_hand") + F.col("units_received")),
    )


def sell_through_rollup(items: DataFrame) -> DataFrame:
    """Per category and in total (``level`` tells which); ratios of sums."""
    rolled = items.rollup("product_category").agg(
        F.when(F.grouping("product_category") == 1, F.lit("total"))
        .otherwise(F.lit("category"))
        .alias("level"),
        *[F.sum(name).alias(name) for name in MEASURES],
    )
    return _with_ratio(rolled)


def top_categories(rollup: DataFrame, limit: int = 12) -> DataFrame:
    """Categories with the most units sold."""
    return (
        rollup.where(F.col("level") == "category")
        .drop("level")
        .orderBy(F.col("units_sold").desc(), "product_category")
        .limit(limit)
    )


def most_sold(items: DataFrame, limit: int) -> DataFrame:
    """The reporting list: products with the most units sold."""
    return items.orderBy(F.col("units_sold").desc(), "product_id").limit(limit)


def best_and_worst(items: DataFrame, limit: int = 10) -> DataFrame:
    """``limit`` products with the highest and the lowest ratio, tagged."""
    columns = ("product_id", "product_name", "units_sold", "sell_through")
    key = F.round(F.col("sell_through"), 6)
    best = items.select(*columns).orderBy(key.desc(), "product_id").limit(limit)
    worst = items.select(*columns).orderBy(key.asc(), "product_id").limit(limit)
    return best.withColumn("group", F.lit("Top")).unionByName(
        worst.withColumn("group", F.lit("Bottom"))
    )
