"""Stock on hand, ledger stock levels, days of cover and stock value."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfledger import constants as K
from shelfledger.functions.columns import (
    any_of,
    day_range,
    moment,
    product_label,
    zero_if_null,
)
from shelfledger.session import cut_lineage

ITEM_COLUMNS = (
    "product_id",
    "product_name",
    "product_category",
    "product_brand",
    "product_barcode",
    "product_sku",
)


def describe_products(items: DataFrame, products: DataFrame) -> DataFrame:
    """Adds product attributes, with fallbacks for products missing in the dimension."""
    rest = [name for name in items.columns if name != "product_id"]
    return items.join(products.select(*ITEM_COLUMNS), "product_id", "left").select(
        "product_id",
        product_label(F.col("product_name"), F.col("product_id")).alias("product_name"),
        F.nvl("product_category", F.lit(K.UNKNOWN_CATEGORY)).alias("product_category"),
        F.nvl("product_brand", F.lit(K.UNKNOWN_BRAND)).alias("product_brand"),
        F.nvl("product_barcode", F.lit("")).alias("product_barcode"),
        F.nvl("product_sku", F.lit("")).alias("product_sku"),
        *rest,
    )


def snapshot_on_hand(snapshots: DataFrame, snapshot_date: date) -> DataFrame:
    return (
        snapshots.where(F.col("snapshot_date") == F.lit(snapshot_date))
        .groupBy("product_id")
        .agg(F.sum("quantity").alias("qty_on_hand"))
    )


def units_sold(by_product: DataFrame, start: date, end: date) -> DataFrame:
    return (
        by_product.where(day_range(F.col("date"), start, end))
        .groupBy("product_id")
        .agg(F.sum("quantity").alias("units_sold"), F.sum("revenue").alias("revenue"))
    )


# --- ledger --------------------------------------------------------------------------------


def utc_of(local: datetime, zone: str = K.LOCAL_ZONE) -> datetime:
    """Zone-less UTC of a local wall-clock time; moves are stored in UTC."""
    return local.replace(tzinfo=ZoneInfo(zone)).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)


def pool_delta(qty: Column, src: Column, dest: Column, pool: Iterable[int]) -> Column:
    """Into the pool +, out of it -, within it 0; an unknown location is outside."""
    pool = sorted(pool)
    from_pool = F.nvl(any_of(src, pool), F.lit(False))
    to_pool = F.nvl(any_of(dest, pool), F.lit(False))
    return (
        F.when(to_pool & ~from_pool, F.abs(qty))
        .when(from_pool & ~to_pool, -F.abs(qty))
        .otherwise(F.lit(0.0))
    )


def _ledger_moves(
    moves: DataFrame, after: datetime, until: datetime, pool: Iterable[int]
) -> DataFrame:
    """(product_id, qty_delta) of each move with after < date <= until."""
    delta = pool_delta(
        F.col("qty_moved"), F.col("location_src_id"), F.col("location_dest_id"), pool
    )
    return moves.where((F.col("date") > moment(after)) & (F.col("date") <= moment(until))).select(
        "product_id", delta.alias("qty_delta")
    )


def ledger_deltas(
    moves: DataFrame,
    after: datetime,
    until: datetime,
    pool: Iterable[int] = K.LEDGER_LOCATION_POOL,
) -> DataFrame:
    """Net quantity per product of the moves with after < date <= until."""
    return (
        _ledger_moves(moves, after, until, pool)
        .groupBy("product_id")
        .agg(F.sum("qty_delta").alias("qty_delta"))
    )


def close_of(day: date) -> datetime:
    """Local moment at which the ledger of a day is cut."""
    return datetime.combine(day, time(K.LEDGER_CUTOFF_HOUR))


def ledger_closes(
    opening: DataFrame,
    moves: DataFrame,
    opened_local: datetime,
    closes: list[date],
    pool: Iterable[int] = K.LEDGER_LOCATION_POOL,
    zone: str = K.LOCAL_ZONE,
) -> DataFrame:
    """(date, product_id, on_hand_qty) at each of the given days, in order: stored ends of ledger periods.

    ``opening`` holds (product_id, qty) at ``opened_local``, e.g. the close before the first one.  Moves are summed
    per product and period first, then added up along the periods: a product has at most one row
    per period in the ordered pass.
    """
    first, last = utc_of(opened_local, zone), utc_of(close_of(closes[-1]), zone)
    ends = F.array(*[moment(utc_of(close_of(day), zone)) for day in closes])
    period = F.size(F.filter(ends, lambda end: end < F.col("date")))
    delta = pool_delta(
        F.col("qty_moved"), F.col("location_src_id"), F.col("location_dest_id"), pool
    )
    inside = moves.where((F.col("date") > moment(first)) & (F.col("date") <= moment(last)))
    steps = opening.select(
        "product_id", F.lit(0).alias("period"), zero_if_null(F.col("qty")).alias("qty")
    ).unionByName(inside.select("product_id", period.alias("period"), delta.alias("qty")))
    summed = steps.groupBy("product_id", "period").agg(F.sum("qty").alias("qty"))
    so_far = Window.partitionBy("product_id").orderBy("period")
    known = summed.select(
        "product_id",
        F.sum("qty").over(so_far.rowsBetween(Window.unboundedPreceding, 0)).alias("on_hand_qty"),
        F.col("period").alias("first"),
        F.nvl(F.lead("period").over(so_far) - 1, F.lit(len(closes) - 1)).alias("last"),
    )
    days = F.array(*[F.lit(day) for day in closes])
    held = F.explode(F.slice(days, F.col("first") + 1, F.col("last") - F.col("first") + 1))
    return known.select(held.alias("date"), "product_id", "on_hand_qty")


def ledger_stock(
    baseline: DataFrame,
    moves: DataFrame,
    sales: DataFrame,
    products: DataFrame,
    as_of: date,
    lookback_days: int = K.STOCK_LOOKBACK_DAYS,
    low_stock_days: int = K.LOW_STOCK_DAYS,
    baseline_local: datetime = K.LEDGER_BASELINE_LOCAL,
    pool: Iterable[int] = K.LEDGER_LOCATION_POOL,
    zone: str = K.LOCAL_ZONE,
) -> DataFrame:
    """Stock per product: opening quantity plus moves, with cover and flags.

    Opening quantities, moves and sales are stacked and summed once per product:
    one shuffle of partial sums, where separate sums would need three joins.
    Products known from sales alone are not stocked.  A cutoff before the opening
    stock gives no rows.
    """
    lookback_days = max(1, lookback_days)
    cutoff = close_of(as_of)
    first_sale_day = as_of - timedelta(days=lookback_days - 1)
    deltas = _ledger_moves(moves, utc_of(baseline_local, zone), utc_of(cutoff, zone), pool)
    sold = sales.where(day_range(F.col("date"), first_sale_day, as_of))

    def part(df: DataFrame, on_hand: Column, units: Column, stocked: bool) -> DataFrame:
        return df.select(
            "product_id",
            on_hand.alias("on_hand_qty"),
            units.alias("units_sold"),
            F.lit(stocked).alias("stocked"),
        )

    nothing = F.lit(0.0)
    per_product = (
        part(baseline, zero_if_null(F.col("qty")), nothing, True)
        .unionByName(part(deltas, zero_if_null(F.col("qty_delta")), nothing, True))
        .unionByName(part(sold, nothing, zero_if_null(F.col("quantity")), False))
        .groupBy("product_id")
        .agg(
            F.sum("on_hand_qty").alias("on_hand_qty"),
            F.sum("units_sold").alias("units_sold"),
            F.max("stocked").alias("stocked"),
        )
        .where("stocked")
        .drop("stocked")
    )
    if cutoff < baseline_local:
        per_product = per_product.limit(0)
    average = F.col("units_sold") / F.lit(float(lookback_days))
    cover = F.when(F.col("avg_daily_sold") > 0, F.col("on_hand_qty") / F.col("avg_daily_sold"))
    levels = (
        per_product.withColumn("avg_daily_sold", average)
        .withColumn("days_of_cover", cover)
        .select(
            "product_id",
            "on_hand_qty",
            F.lit(0.0).alias("reserved_qty"),
            "units_sold",
            "avg_daily_sold",
            "days_of_cover",
            F.nvl(F.col("days_of_cover") < low_stock_days, F.lit(False)).alias(
                "low_stock_flag"
            ),
            ((F.col("on_hand_qty") > 0) & (F.col("units_sold") <= 0)).alias("dead_stock_flag"),
        )
    )
    return describe_products(levels, products)


def stock_totals(items: DataFrame) -> DataFrame:
    """Total on hand and flag counts of any (also filtered) stock list."""
    total = zero_if_null(F.sum("on_hand_qty"))
    return items.agg(
        F.when(F.abs(total) < 1e-9, F.lit(0.0)).otherwise(total).alias("total_on_hand"),
        F.count_if("low_stock_flag").alias("low_stock_count"),
        F.count_if("dead_stock_flag").alias("dead_stock_count"),
    )


def cover_histogram(items: DataFrame, bins: int = 20) -> DataFrame:
    """SKU counts in equal-width bins of days of cover; empty bins are listed.

    The one column needed is stored once, as bounds and counts both read it.  The
    bounds are a scalar subquery; every row finds its bin by arithmetic and rows
    are counted on the map side.
    """
    cover = cut_lineage(
        items.where(F.col("days_of_cover").isNotNull()).select("days_of_cover")
    )
    bounds = cover.agg(
        F.struct(F.min("days_of_cover").alias("low"), F.max("days_of_cover").alias("high"))
    ).scalar()
    low, high = F.col("bounds.low"), F.col("bounds.high")
    width = (high - low) / F.lit(float(bins))
    position = F.when(width > 0, F.floor((F.col("days_of_cover") - low) / width)).otherwise(
        F.lit(0)
    )
    counts = (
        cover.withColumn("bounds", bounds)
        .groupBy(F.least(position, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("sku_count"))
    )
    return (
        items.sparkSession.range(bins)
        .select(F.col("id").cast("int").alias("bin"))
        .withColumn("bounds", bounds)
        .join(counts, "bin", "left")
        .where(low.isNotNull())
        .select(
            "bin",
            (low + F.col("bin") * width).alias("cover_from"),
            (low + (F.col("bin") + 1) * width).alias("cover_to"),
            F.nvl("sku_count", F.lit(0)).alias("sku_count"),
        )
        .orderBy("bin")
    )


def lowest_cover(items: DataFrame, limit: int = 10) -> DataFrame:
    """Low-stock products with the least cover."""
    return (
        items.where("low_stock_flag")
        .orderBy(F.col("days_of_cover"), F.col("product_id"))
        .select("product_id", "product_name", "on_hand_qty", "days_of_cover")
        .limit(limit)
    )


# Quick filters of the stock list.
QUICK_FILTERS = ("all", "low", "dead", "healthy")


def quick_filter(items: DataFrame, name: str) -> DataFrame:
    """``low``, ``dead`` or ``healthy`` (no flag and something on hand)."""
    low, dead = F.col("low_stock_flag"), F.col("dead_stock_flag")
    if name == "low":
        return items.where(low)
    if name == "dead":
        return items.where(dead)
    if name == "healthy":
        return items.where(~low & ~dead & (F.col("on_hand_qty") > 0))
    if name == "all":
        return items
    raise ValueError(f"filter must be one of {QUICK_FILTERS}, not {name!r}")


# --- summary cards ---------------------------------------------------------------------------


def stock_status(
    snapshots: DataFrame,
    by_product: DataFrame,
    snapshot_date: date,
    lookback_days: int = K.STOCK_LOOKBACK_DAYS,
    overstock_days: int = K.OVERSTOCK_DAYS,
    low_stock_days: int = K.SUMMARY_LOW_STOCK_DAYS,
) -> DataFrame:
    """Status and value (at average sale price) of each product of a snapshot.

    Sales count only for products with a non-zero quantity.
    """
    first_day = snapshot_date - timedelta(days=lookback_days - 1)
    stock = snapshots.where(F.col("snapshot_date") == F.lit(snapshot_date)).select(
        "product_id",
        F.col("quantity").alias("on_hand_qty"),
        F.lit(0.0).alias("units_sold"),
        F.lit(0.0).alias("revenue"),
        F.lit(True).alias("stocked"),
    )
    sold = by_product.where(day_range(F.col("date"), first_day, snapshot_date)).select(
        "product_id",
        F.lit(0.0).alias("on_hand_qty"),
        F.col("quantity").alias("units_sold"),
        "revenue",
        F.lit(False).alias("stocked"),
    )
    has_stock = F.col("on_hand_qty") != 0
    per_product = (
        stock.unionByName(sold)
        .groupBy("product_id")
        .agg(
            F.sum("on_hand_qty").alias("on_hand_qty"),
            F.sum("units_sold").alias("units_sold"),
            F.sum("revenue").alias("revenue"),
            F.max("stocked").alias("stocked"),
        )
        .where("stocked")
        .drop("stocked")
        .withColumns(
            {
                "units_sold": F.when(has_stock, F.col("units_sold")).otherwise(F.lit(0.0)),
                "revenue": F.when(has_stock, F.col("revenue")).otherwise(F.lit(0.0)),
            }
        )
        .withColumn("avg_daily_sold", F.col("units_sold") / F.lit(float(lookback_days)))
    )
    cover = F.when(
        F.col("avg_daily_sold") > 0, F.col("on_hand_qty") / F.col("avg_daily_sold")
    ).otherwise(F.lit(float(K.NO_SALES_COVER)))
    status = (
        F.when(F.col("units_sold") == 0, F.lit("dead_stock"))
        .when(F.col("days_of_cover") < low_stock_days, F.lit("low_stock"))
        .when(F.col("days_of_cover") > overstock_days, F.lit("overstock"))
        .otherwise(F.lit("healthy"))
    )
    price = F.when(F.col("units_sold") > 0, F.col("revenue") / F.col("units_sold")).otherwise(
        F.lit(0.0)
    )
    return (
        per_product.withColumn("days_of_cover", cover)
        .withColumn("stock_status", status)
        .withColumn("est_stock_value", F.col("on_hand_qty") * price)
    )


def summary_cards(status: DataFrame) -> DataFrame:
    """One row of counts and values over :func:`stock_status`."""
    state = F.col("stock_status")
    return status.agg(
        F.count(F.lit(1)).alias("total_sku_count"),
        zero_if_null(F.sum("est_stock_value")).alias("total_inventory_value"),
        F.count_if(state == "dead_stock").alias("dead_stock_count"),
        F.count_if(state == "low_stock").alias("low_stock_count"),
        F.count_if(state == "overstock").alias("overstock_sku_count"),
        zero_if_null(F.sum(F.when(state == "overstock", F.col("est_stock_value")))).alias(
            "overstock_value"
        ),
    )


# --- movement breakdown -----------------------------------------------------------------------


def movement_breakdown(moves: DataFrame, start: date, end: date) -> DataFrame:
    """Moved units per product by kind of movement."""
    kind, qty = F.col("movement_type"), F.col("qty_moved")

    def total(condition: Column) -> Column:
        return zero_if_null(F.sum(F.when(condition, qty)))

    return (
        moves.where(day_range(F.col("date"), start, end))
        .groupBy("product_id")
        .agg(
            total(kind.isin("incoming", "production_in")).alias("units_received"),
            total(kind == "incoming").alias("units_incoming"),
            total(kind == "production_in").alias("units_production_in"),
            total(F.col("inventory_adjustment_flag")).alias("units_adjustment_net"),
            total(kind == "production_out").alias("units_production_out"),
            total(kind == "transfer").alias("units_transfer_net"),
        )
    )
