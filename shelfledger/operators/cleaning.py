"""Raw records to clean records, and clean records to facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfledger import constants as K
from shelfledger.functions.columns import conform, local_timestamp, parse_day, zero_if_null
from shelfledger.functions.skew import splittable
from shelfledger.schemas import (
    DAILY_TABLES,
    FACT_INVENTORY_MOVES,
    FACT_STOCK_SNAPSHOT,
    RAW_INVENTORY_MOVES,
    RAW_INVOICE_LINES,
    RAW_POS_LINES,
    RAW_STOCK_QUANTS,
)


def clean_pos(raw: DataFrame, zone: str = K.LOCAL_ZONE) -> DataFrame:
    """Local timestamps, typed ids, revenue = price including tax - discount."""
    return raw.select(*conform(raw, RAW_POS_LINES)).select(
        local_timestamp(F.col("order_date"), zone).alias("date"),
        "order_id",
        "order_ref",
        "pos_config_id",
        "cashier_id",
        "customer_id",
        "payment_method_ids",
        "line_id",
        "product_id",
        zero_if_null(F.col("qty")).alias("quantity"),
        (zero_if_null(F.col("price_subtotal_incl")) - F.col("discount_amount")).alias("revenue"),
    )


def _clean_document_lines(raw: DataFrame, *roles: str) -> DataFrame:
    return raw.select(*conform(raw, RAW_INVOICE_LINES)).select(
        parse_day(F.col("move_date")).alias("date"),
        "move_id",
        F.nvl("move_name", F.lit("")).alias("move_name"),
        *[
            column
            for role in roles
            for column in (
                F.col(f"{role}_id"),
                F.nvl(f"{role}_name", F.lit("")).alias(f"{role}_name"),
            )
        ],
        "move_line_id",
        "product_id",
        zero_if_null(F.col("price_unit")).alias("price_unit"),
        zero_if_null(F.col("quantity")).alias("quantity"),
        "tax_id",
        "tax_ids_json",
    )


def clean_invoices(raw: DataFrame) -> DataFrame:
    """Customer invoice lines."""
    return _clean_document_lines(raw, "customer")


def clean_bills(raw: DataFrame) -> DataFrame:
    """Vendor bill lines with the discounts of a bill spread over its goods."""
    return allocate_discounts(_clean_document_lines(raw, "vendor", "purchase_order"))


def allocate_discounts(lines: DataFrame) -> DataFrame:
    """Lines with a negative price are discounts of their document.

    Every other line's price shrinks by discount / gross of the document, and a
    discount line itself costs 0.  Only documents that have a discount reach the
    join, and totals are summed before they are shuffled; there is no window over
    a whole document, and the join can split a document of any size.
    """
    amount = F.col("price_unit") * F.col("quantity")
    is_discount = F.col("price_unit") < 0
    rates = (
        lines.groupBy("move_id")
        .agg(
            F.sum(F.when(~is_discount, amount).otherwise(0.0)).alias("gross"),
            F.sum(F.when(is_discount, amount).otherwise(0.0)).alias("discount"),
        )
        .where((F.col("discount") != 0) & (F.col("gross") != 0))
        .select("move_id", (F.col("discount") / F.col("gross")).alias("discount_pct"))
    )
    price = F.when(F.col("price_unit") < 0, F.lit(0.0)).otherwise(
        F.col("price_unit") * (F.lit(1.0) + zero_if_null(F.col("discount_pct")))
    )
    names = lines.columns
    after = names.index("price_unit") + 1
    return (
        lines.join(splittable(rates), "move_id", "left")
        .withColumn("actual_price", price)
        .select(*names[:after], "actual_price", *names[after:])
    )


def clean_quants(raw: DataFrame) -> DataFrame:
    """Stock quants with a product."""
    rows = raw.select(*conform(raw, RAW_STOCK_QUANTS)).where(F.col("product_id").isNotNull())
    rows = rows.withColumn("snapshot_date", parse_day(F.col("snapshot_date")))
    return rows.select(*conform(rows, FACT_STOCK_SNAPSHOT))


def clean_moves(
    raw: DataFrame,
    products: DataFrame,
    locations: DataFrame,
    uoms: DataFrame,
    partners: DataFrame,
) -> DataFrame:
    """Stock moves with a product, and the names of everything they point to.

    The joins carry no hint: small dimensions are broadcast once their measured
    size allows it, others are shuffled with hot keys split.
    """
    rows = raw.select(*conform(raw, RAW_INVENTORY_MOVES)).where(F.col("product_id").isNotNull())

    def place(side: str) -> DataFrame:
        return locations.select(
            F.col("location_id").alias(f"location_{side}_id"),
            F.col("location_name").alias(f"location_{side}_name"),
            F.col("location_usage").alias(f"location_{side}_usage"),
        )

    def partner(side: str) -> DataFrame:
        return partners.select(
            F.col("partner_id").alias(f"{side}_partner_id"),
            F.col("partner_name").alias(f"{side}_partner_name"),
        )

    joined = (
        rows.withColumnRenamed("movement_date", "date")
        .join(products.select("product_id", "product_name", "product_brand"), "product_id", "left")
        .join(place("src"), "location_src_id", "left")
        .join(place("dest"), "location_dest_id", "left")
        .join(uoms.select("uom_id", "uom_name", "uom_category"), "uom_id", "left")
        .join(partner("source"), "source_partner_id", "left")
        .join(partner("destination"), "destination_partner_id", "left")
    )
    names = (
        "product_name",
        "product_brand",
        "location_src_name",
        "location_dest_name",
        "uom_name",
        "uom_category",
        "source_partner_name",
        "destination_partner_name",
    )
    return joined.withColumns({name: F.nvl(name, F.lit("")) for name in names}).select(
        *[name for name, _, _ in FACT_INVENTORY_MOVES]
    )


def load_fact(clean: DataFrame, table: str) -> DataFrame:
    """Final projection of a clean frame to its fact table."""
    return clean.select(*conform(clean, DAILY_TABLES[table]))
