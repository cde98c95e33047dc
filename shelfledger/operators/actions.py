"""Action lists built from stock, ABC class and cost: reorder, markdown, best sellers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from shelfledger import constants as K
from shelfledger.functions.columns import any_of, contains_text, zero_if_null
from shelfledger.operators.sales import ranked_money


def stock_position(
    stock: DataFrame,
    abc_items: DataFrame,
    costs: DataFrame,
    target_days: int = K.REORDER_TARGET_DAYS,
) -> DataFrame:
    """Stock list with class, revenue, cost value and reorder quantity.

    A product without sales in the ABC range is class C; one without a known
    cost is worth 0.
    """
    classes = abc_items.select("product_id", "abc_class", "revenue")
    priced = costs.select("product_id", "cost_unit_tax_in")
    wanted = F.lit(float(target_days)) * F.col("avg_daily_sold") - F.col("on_hand_qty")
    return (
        stock.join(classes, "product_id", "left")
        .join(priced, "product_id", "left")
        .withColumns(
            {
                "abc_class": F.nvl("abc_class", F.lit("C")),
                "revenue": zero_if_null(F.col("revenue")),
                "cost_unit_tax_in": zero_if_null(F.col("cost_unit_tax_in")),
                "reorder_qty": F.ceil(F.greatest(wanted, F.lit(0.0))),
            }
        )
        .withColumn("est_stock_value", F.col("cost_unit_tax_in") * F.col("on_hand_qty"))
    )


def cost_valuation(stock: DataFrame, costs: DataFrame) -> DataFrame:
    """Value of the stock on hand at cost; 0 where the cost is unknown."""
    return (
        stock.join(costs.select("product_id", "cost_unit_tax_in"), "product_id", "left")
        .withColumn("cost_unit_tax_in", zero_if_null(F.col("cost_unit_tax_in")))
        .withColumn("est_stock_value", F.col("cost_unit_tax_in") * F.col("on_hand_qty"))
    )


def _has_stock() -> Column:
    return F.col("on_hand_qty") > 0


def needs_reorder(alert_days: int = K.REORDER_ALERT_DAYS) -> Column:
    """Class A or B that runs out soon, or has run out while it is in demand."""
    low_cover = F.nvl(F.col("days_of_cover") < alert_days, F.lit(False))
    sold_out = ~_has_stock() & (F.col("avg_daily_sold") > 0)
    return F.col("abc_class").isin("A", "B") & (low_cover | sold_out)


def needs_markdown(overstock_days: int = K.OVERSTOCK_DAYS) -> Column:
    """Class C with stock that lasts too long or does not sell."""
    cover = F.col("days_of_cover")
    excess = cover.isNull() | (cover > overstock_days) | F.col("dead_stock_flag")
    return (F.col("abc_class") == "C") & _has_stock() & excess


def is_top_performer() -> Column:
    return (
        (F.col("abc_class") == "A")
        & ~F.col("low_stock_flag")
        & ~F.col("dead_stock_flag")
        & _has_stock()
    )


def reorder_list(position: DataFrame) -> DataFrame:
    """Shortest cover first, then highest revenue."""
    return position.where(needs_reorder()).orderBy(
        F.col("days_of_cover").asc_nulls_last(), ranked_money("revenue").desc(), "product_id"
    )


def markdown_list(position: DataFrame) -> DataFrame:
    """Highest value at cost first."""
    return position.where(needs_markdown()).orderBy(
        ranked_money("est_stock_value").desc(), "product_id"
    )


def top_performers(position: DataFrame) -> DataFrame:
    return position.where(is_top_performer()).orderBy(
        ranked_money("revenue").desc(), "product_id"
    )


def action_summary(position: DataFrame, overstock_days: int = K.OVERSTOCK_DAYS) -> DataFrame:
    """Counts and money behind the action lists, in one pass."""
    reorder, markdown = needs_reorder(), needs_markdown()
    overstock = F.nvl(F.col("days_of_cover") > overstock_days, F.lit(False))
    value = F.col("est_stock_value")

    def total(condition: Column, amount: Column) -> Column:
        return zero_if_null(F.sum(F.when(condition, amount)))

    return position.agg(
        (F.count_if(reorder) + F.count_if(markdown)).alias("attention_count"),
        total(reorder, F.col("revenue")).alias("revenue_at_risk"),
        total(markdown, value).alias("capital_locked"),
        F.count_if(~(reorder | markdown) & _has_stock()).alias("healthy_count"),
        total(overstock, value).alias("overstock_value"),
        F.count_if(overstock).alias("overstock_sku_count"),
        F.count_if("low_stock_flag").alias("low_stock_count"),
        F.count_if("dead_stock_flag").alias("dead_stock_count"),
        zero_if_null(F.sum(value)).alias("total_inventory_value"),
        F.count(F.lit(1)).alias("total_sku_count"),
    )


# --- filters -------------------------------------------------------------------------------


def vendor_products(purchases: DataFrame, vendor_ids: Iterable[int]) -> DataFrame:
    """Distinct products ever bought from the vendors."""
    return (
        purchases.where(any_of(F.col("vendor_id"), vendor_ids) & (F.col("product_id") != 0))
        .select("product_id")
        .distinct()
    )


def apply_filters(
    items: DataFrame,
    categories: Iterable[str] = (),
    brands: Iterable[str] = (),
    barcode: str = "",
    vendor_ids: Iterable[int] = (),
    purchases: DataFrame | None = None,
) -> DataFrame:
    """Category, brand, barcode text and distributor filters; empty means no filter."""
    categories, brands, vendor_ids = list(categories), list(brands), list(vendor_ids)
    if categories:
        items = items.where(any_of(F.col("product_category"), categories))
    if brands:
        items = items.where(any_of(F.col("product_brand"), brands))
    if barcode.strip():
        items = items.where(contains_text(F.col("product_barcode"), barcode.strip()))
    if vendor_ids:
        if purchases is None:
            raise ValueError("a distributor filter needs the purchases")
        items = items.join(vendor_products(purchases, vendor_ids), "product_id", "left_semi")
    return items


def filter_options(products: DataFrame, purchases: DataFrame) -> DataFrame:
    """Choices for the filters: (kind, value, label)."""

    def named(kind: str, column: str) -> DataFrame:
        return (
            products.where(F.col(column) != "")
            .select(F.lit(kind).alias("kind"), F.col(column).alias("value"))
            .distinct()
            .withColumn("label", F.col("value"))
        )

    vendor = F.col("vendor_id").cast("string")
    vendors = (
        purchases.where(F.col("vendor_id") != 0)
        .select(
            F.lit("distributor").alias("kind"),
            vendor.alias("value"),
            F.nvl(F.nullif(F.trim("vendor_name"), F.lit("")), vendor).alias("label"),
        )
        .distinct()
    )
    return named("category", "product_category").unionByName(
        named("brand", "product_brand")
    ).unionByName(vendors)
