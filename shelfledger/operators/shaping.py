"""Record shaping: staged header and line tables to line-grain records."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from shelfledger.functions.columns import as_json_ids, conform, first_filled, zero_if_null
from shelfledger.functions.skew import splittable
from shelfledger.schemas import RAW_INVENTORY_MOVES, Spec

# Picking type code -> movement type.  Other codes have none.
PICKING_MOVEMENTS = {"incoming": "incoming", "internal": "transfer"}


def normalise(df: DataFrame, spec: Spec) -> DataFrame:
    """Raw records with exactly the declared columns, types and defaults."""
    return df.select(*conform(df, spec))


# --- point of sale -----------------------------------------------------------------


def payment_methods(payments: DataFrame) -> DataFrame:
    """Sorted distinct methods of the payments above 0, as JSON, per order.

    Repeated (order, method) pairs are dropped first, so what is gathered per
    order is bounded by the number of payment methods.
    """
    return (
        payments.where((F.col("amount") > 0) & F.col("method_id").isNotNull())
        .select("order_id", "method_id")
        .distinct()
        .groupBy("order_id")
        .agg(as_json_ids(F.array_sort(F.collect_list("method_id"))).alias("payment_method_ids"))
    )


def of_days(
    headers: DataFrame, column: str, start: date | None, end: date | None
) -> DataFrame:
    """Headers whose date text lies in [start, end], the whole last day included.

    The text begins with YYYY-MM-DD, so days compare as text: the filter reaches the scan, and row groups of
    other days are skipped.
    """
    if start is not None:
        headers = headers.where(F.col(column) >= start.isoformat())
    if end is not None:
        headers = headers.where(F.col(column) < (end + timedelta(days=1)).isoformat())
    return headers


def of_headers(rows: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """Rows of the given headers only: a semi join, for which Spark filters the scan at run time."""
    return rows.join(headers.select(key).distinct(), key, "left_semi")


def pos_lines(
    orders: DataFrame,
    lines: DataFrame,
    payments: DataFrame,
    products: DataFrame,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Order lines with header, payment methods and product attributes.

    Orders without lines and lines without a product drop out; an order without
    payments has ``[]``; an unknown product has brand ``Unknown``.  With a window of days
    only its orders are taken, and only their lines and payments are gathered.
    """
    orders = of_days(orders, "order_date", start, end)
    if start is not None or end is not None:
        payments = of_headers(payments, orders, "order_id")
    headers = orders.join(payment_methods(payments), "order_id", "left").withColumn(
        "payment_method_ids", F.nvl("payment_method_ids", F.lit("[]"))
    )
    attributes = products.select(
        "product_id",
        "product_brand",
        "product_brand_id",
        "product_name",
        "product_category",
        "product_parent_category",
    )
    return (
        lines.where(F.col("product_id").isNotNull())
        .join(splittable(headers), "order_id")
        .join(attributes, "product_id", "left")
        .select(
            "order_date",
            "order_id",
            "order_ref",
            "pos_config_id",
            "cashier_id",
            "customer_id",
            zero_if_null(F.col("amount_total")).alias("amount_total"),
            "payment_method_ids",
            "line_id",
            "product_id",
            zero_if_null(F.col("qty")).alias("qty"),
            zero_if_null(F.col("price_subtotal_incl")).alias("price_subtotal_incl"),
            zero_if_null(F.col("discount_amount")).alias("discount_amount"),
            F.nvl("product_brand", F.lit("Unknown")).alias("product_brand"),
            "product_brand_id",
            "product_name",
            "product_category",
            "product_parent_category",
        )
    )


# --- invoices and bills -------------------------------------------------------------


def primary_tax(tax_ids: Column) -> tuple[Column, Column]:
    """(lowest tax id or NULL, all distinct ids sorted as JSON)."""
    ids = F.array_sort(F.array_distinct(F.array_compact(F.nvl(tax_ids, F.array().cast("array<bigint>")))))
    return F.get(ids, F.lit(0)), as_json_ids(ids)


def invoice_lines(
    moves: DataFrame,
    lines: DataFrame,
    move_type: str,
    partner_role: str,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Lines of posted documents of one type; the partner takes its role's name."""
    headers = moves.where((F.col("move_type") == move_type) & (F.col("state") == "posted"))
    headers = of_days(headers, "move_date", start, end)
    tax_id, tax_ids_json = primary_tax(F.col("tax_ids"))
    return lines.join(
        headers.select("move_id", "move_name", "move_date", "partner_id", "partner_name"), "move_id"
    ).select(
        "move_id",
        "move_name",
        "move_date",
        F.col("partner_id").alias(f"{partner_role}_id"),
        F.col("partner_name").alias(f"{partner_role}_name"),
        "purchase_order_id",
        "purchase_order_name",
        "move_line_id",
        "product_id",
        zero_if_null(F.col("price_unit")).alias("price_unit"),
        zero_if_null(F.col("quantity")).alias("quantity"),
        tax_id.alias("tax_id"),
        tax_ids_json.alias("tax_ids_json"),
    )


# --- inventory moves ---------------------------------------------------------------


def _inside(usage: Column) -> Column:
    return F.nvl(usage == "internal", F.lit(False))


def signed_quantity(qty: Column, src_usage: Column, dest_usage: Column) -> Column:
    """Leaving the stores is negative, entering is positive, the rest is as done."""
    src, dest = _inside(src_usage), _inside(dest_usage)
    return F.when(src & ~dest, -F.abs(qty)).when(~src & dest, F.abs(qty)).otherwise(qty)


def _is_adjustment(
    src_usage: Column, dest_usage: Column, raw_mo: Column, prod_mo: Column
) -> Column:
    touches_inventory = F.nvl(src_usage == "inventory", F.lit(False)) | F.nvl(
        dest_usage == "inventory", F.lit(False)
    )
    return touches_inventory & raw_mo.isNull() & prod_mo.isNull()


def movement_type(
    picking_code: Column,
    src_usage: Column,
    dest_usage: Column,
    dest_scrap: Column,
    raw_mo: Column,
    prod_mo: Column,
) -> Column:
    """Scrap has no type; then production, then adjustment, then the picking's code."""
    by_picking = F.lit(None).cast("string")
    for code, name in PICKING_MOVEMENTS.items():
        by_picking = F.when(picking_code == code, F.lit(name)).otherwise(by_picking)
    return (
        F.when(F.nvl(dest_scrap, F.lit(False)), F.lit(None).cast("string"))
        .when(raw_mo.isNotNull(), F.lit("production_out"))
        .when(prod_mo.isNotNull(), F.lit("production_in"))
        .when(_is_adjustment(src_usage, dest_usage, raw_mo, prod_mo), F.lit("adjustment"))
        .otherwise(by_picking)
    )


def move_lines(
    lines: DataFrame,
    moves: DataFrame,
    pickings: DataFrame,
    picking_types: DataFrame,
    locations: DataFrame,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Done stock move lines with sign, type, partner side and reference resolved.

    With a window of days only lines that moved on them are taken, before anything is joined.
    """
    lines = of_days(lines, "movement_date", start, end)
    move = moves.where(F.col("state") == "done").select(
        "move_id",
        F.col("name").alias("m_name"),
        F.col("reference").alias("m_reference"),
        F.col("origin").alias("m_origin"),
        F.col("picking_id").alias("m_picking_id"),
        F.col("picking_type_id").alias("m_picking_type_id"),
        F.col("raw_material_production_id").alias("raw_mo"),
        F.col("production_id").alias("prod_mo"),
        F.col("create_uid").alias("m_create_uid"),
        F.col("create_date").alias("m_create_date"),
    )
    picking = pickings.select(
        "picking_id",
        F.col("name").alias("p_name"),
        F.col("origin").alias("p_origin"),
        F.col("partner_id").alias("p_partner_id"),
        F.col("picking_type_id").alias("p_picking_type_id"),
    )
    types = picking_types.select(
        F.col("picking_type_id").alias("type_id"), F.col("code").alias("picking_type_code")
    )

    def place(side: str) -> DataFrame:
        return locations.select(
            F.col("location_id").alias(f"location_{side}_id"),
            F.col("location_usage").alias(f"{side}_usage"),
            F.col("scrap_location").alias(f"{side}_scrap"),
        )

    src, dest = F.col("src_usage"), F.col("dest_usage")
    joined = (
        lines.where((F.col("qty_done") != 0) & F.col("move_line_id").isNotNull())
        .join(move, "move_id")
        .withColumn("picking_id", F.nvl("picking_id", "m_picking_id"))
        .join(picking, "picking_id", "left")
        .withColumn("type_id", F.nvl("p_picking_type_id", "m_picking_type_id"))
        .join(types, "type_id", "left")
        .join(place("src").drop("src_scrap"), "location_src_id", "left")
        .join(place("dest"), "location_dest_id", "left")
    )
    inbound = ~_inside(src) & _inside(dest)
    outbound = _inside(src) & ~_inside(dest)
    origin = first_filled(F.col("p_origin"), F.col("m_origin"))
    shaped = joined.select(
        "move_id",
        "move_line_id",
        "movement_date",
        "product_id",
        "location_src_id",
        "location_dest_id",
        signed_quantity(F.col("qty_done"), src, dest).alias("qty_moved"),
        "uom_id",
        movement_type(
            F.col("picking_type_code"),
            src,
            dest,
            F.col("dest_scrap"),
            F.col("raw_mo"),
            F.col("prod_mo"),
        ).alias("movement_type"),
        _is_adjustment(src, dest, F.col("raw_mo"), F.col("prod_mo")).alias(
            "inventory_adjustment_flag"
        ),
        F.nvl("raw_mo", "prod_mo").alias("manufacturing_order_id"),
        "picking_id",
        "picking_type_code",
        first_filled(F.col("p_name"), F.col("m_reference"), F.col("m_name"), origin).alias(
            "reference"
        ),
        origin.alias("origin_reference"),
        F.when(inbound, F.col("p_partner_id")).alias("source_partner_id"),
        F.when(outbound, F.col("p_partner_id")).alias("destination_partner_id"),
        F.nvl("create_uid", "m_create_uid").alias("created_by_user"),
        first_filled(F.col("create_date"), F.col("m_create_date")).alias("create_date"),
    )
    return normalise(shaped, RAW_INVENTORY_MOVES)


# --- stock quants ------------------------------------------------------------------


def quant_snapshot(quants: DataFrame, snapshot_date: date) -> DataFrame:
    """Non-zero quants stamped with the snapshot day (as text, like all raw dates)."""
    return quants.where((F.col("quantity") != 0) & F.col("quant_id").isNotNull()).withColumn(
        "snapshot_date", F.lit(snapshot_date.isoformat())
    )
