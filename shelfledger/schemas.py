"""Column lists of the lake tables: (column, Spark type, value used for NULL).

Fixed values: names and types are the storage contract of the lake.  A default
of ``None`` leaves NULL in place.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import types as T

Spec = list[tuple[str, str, object]]

# --- raw layer: one row per extracted record, dates still as text -------------

RAW_POS_LINES: Spec = [
    ("order_date", "string", None),
    ("order_id", "bigint", None),
    ("order_ref", "string", None),
    ("pos_config_id", "bigint", None),
    ("cashier_id", "bigint", None),
    ("customer_id", "bigint", None),
    ("amount_total", "double", None),
    ("payment_method_ids", "string", "[]"),
    ("line_id", "bigint", None),
    ("product_id", "bigint", None),
    ("qty", "double", None),
    ("price_subtotal_incl", "double", None),
    ("discount_amount", "double", 0.0),
    ("product_brand", "string", None),
    ("product_brand_id", "bigint", None),
    ("product_name", "string", None),
    ("product_category", "string", None),
    ("product_parent_category", "string", None),
]

RAW_INVOICE_LINES: Spec = [
    ("move_id", "bigint", None),
    ("move_name", "string", None),
    ("move_date", "string", None),
    ("customer_id", "bigint", None),
    ("customer_name", "string", None),
    ("vendor_id", "bigint", None),
    ("vendor_name", "string", None),
    ("purchase_order_id", "bigint", None),
    ("purchase_order_name", "string", None),
    ("move_line_id", "bigint", None),
    ("product_id", "bigint", None),
    ("price_unit", "double", None),
    ("quantity", "double", None),
    ("tax_id", "bigint", None),
    ("tax_ids_json", "string", "[]"),
]

RAW_INVENTORY_MOVES: Spec = [
    ("move_id", "bigint", None),
    ("move_line_id", "bigint", None),
    ("movement_date", "string", None),
    ("product_id", "bigint", None),
    ("location_src_id", "bigint", None),
    ("location_dest_id", "bigint", None),
    ("qty_moved", "double", 0.0),
    ("uom_id", "bigint", None),
    ("movement_type", "string", None),
    ("inventory_adjustment_flag", "boolean", False),
    ("manufacturing_order_id", "bigint", None),
    ("picking_id", "bigint", None),
    ("picking_type_code", "string", None),
    ("reference", "string", None),
    ("origin_reference", "string", None),
    ("source_partner_id", "bigint", None),
    ("destination_partner_id", "bigint", None),
    ("created_by_user", "bigint", None),
    ("create_date", "string", None),
]

RAW_STOCK_QUANTS: Spec = [
    ("quant_id", "bigint", None),
    ("snapshot_date", "string", None),
    ("product_id", "bigint", None),
    ("location_id", "bigint", None),
    ("lot_id", "bigint", None),
    ("owner_id", "bigint", None),
    ("company_id", "bigint", None),
    ("quantity", "double", 0.0),
    ("reserved_quantity", "double", 0.0),
]

# --- facts ---------------------------------------------------------------------

FACT_SALES: Spec = [
    ("date", "timestamp_ntz", None),
    ("order_id", "bigint", 0),
    ("order_ref", "string", ""),
    ("pos_config_id", "bigint", 0),
    ("cashier_id", "bigint", 0),
    ("customer_id", "bigint", 0),
    ("payment_method_ids", "string", "[]"),
    ("line_id", "bigint", 0),
    ("product_id", "bigint", 0),
    ("quantity", "double", 0.0),
    ("revenue", "double", 0.0),
]

FACT_INVOICE_SALES: Spec = [
    ("date", "date", None),
    ("move_id", "bigint", 0),
    ("move_name", "string", ""),
    ("customer_id", "bigint", 0),
    ("customer_name", "string", ""),
    ("move_line_id", "bigint", 0),
    ("product_id", "bigint", 0),
    ("price_unit", "double", 0.0),
    ("quantity", "double", 0.0),
    ("tax_id", "bigint", None),
    ("tax_ids_json", "string", "[]"),
    ("is_free_item", "boolean", False),
]

FACT_PURCHASES: Spec = [
    ("date", "date", None),
    ("move_id", "bigint", 0),
    ("move_name", "string", ""),
    ("vendor_id", "bigint", 0),
    ("vendor_name", "string", ""),
    ("purchase_order_id", "bigint", None),
    ("purchase_order_name", "string", ""),
    ("move_line_id", "bigint", 0),
    ("product_id", "bigint", 0),
    ("price_unit", "double", 0.0),
    ("actual_price", "double", 0.0),
    ("quantity", "double", 0.0),
    ("tax_id", "bigint", None),
    ("tax_name", "string", ""),
    ("tax_ids_json", "string", "[]"),
    ("is_free_item", "boolean", False),
]

FACT_INVENTORY_MOVES: Spec = [
    ("date", "timestamp_ntz", None),
    ("move_id", "bigint", 0),
    ("move_line_id", "bigint", None),
    ("product_id", "bigint", None),
    ("product_name", "string", ""),
    ("product_brand", "string", ""),
    ("location_src_id", "bigint", None),
    ("location_src_name", "string", ""),
    ("location_src_usage", "string", None),
    ("location_dest_id", "bigint", None),
    ("location_dest_name", "string", ""),
    ("location_dest_usage", "string", None),
    ("qty_moved", "double", 0.0),
    ("uom_id", "bigint", None),
    ("uom_name", "string", ""),
    ("uom_category", "string", ""),
    ("movement_type", "string", ""),
    ("inventory_adjustment_flag", "boolean", False),
    ("manufacturing_order_id", "bigint", None),
    ("picking_id", "bigint", None),
    ("picking_type_code", "string", ""),
    ("reference", "string", ""),
    ("origin_reference", "string", ""),
    ("source_partner_id", "bigint", None),
    ("source_partner_name", "string", ""),
    ("destination_partner_id", "bigint", None),
    ("destination_partner_name", "string", ""),
    ("created_by_user", "bigint", None),
    ("create_date", "timestamp_ntz", None),
]

FACT_STOCK_SNAPSHOT: Spec = [
    ("snapshot_date", "date", None),
    ("quant_id", "bigint", 0),
    ("product_id", "bigint", 0),
    ("location_id", "bigint", None),
    ("lot_id", "bigint", None),
    ("owner_id", "bigint", None),
    ("company_id", "bigint", None),
    ("quantity", "double", 0.0),
    ("reserved_quantity", "double", 0.0),
]

# --- costs, profit, aggregates ---------------------------------------------------

COST_ROWS: Spec = [
    ("date", "date", None),
    ("product_id", "bigint", 0),
    ("cost_unit_tax_in", "double", 0.0),
    ("source_move_id", "bigint", 0),
    ("source_tax_id", "bigint", 0),
]

BEGINNING_COSTS: Spec = [
    ("product_id", "bigint", 0),
    ("cost_unit_tax_in", "double", 0.0),
    ("source_tax_id", "bigint", 0),
    ("effective_date", "date", date(2025, 2, 10)),
    ("is_active", "boolean", True),
    ("notes", "string", ""),
]

LEGACY_COSTS: Spec = [
    ("product_id", "bigint", 0),
    ("cost_unit_tax_in", "double", 0.0),
    ("source_tax_id", "bigint", 0),
    ("effective_date", "date", date(2025, 2, 10)),
    ("cost_source", "string", "unknown"),
    ("priority", "int", 3),
    ("is_active", "boolean", True),
    ("created_at", "timestamp_ntz", datetime(2025, 2, 10)),
    ("notes", "string", ""),
]

PROFIT_LINES: Spec = [
    ("date", "date", None),
    ("txn_id", "bigint", 0),
    ("line_id", "bigint", 0),
    ("product_id", "bigint", 0),
    ("quantity", "double", 0.0),
    ("revenue_tax_in", "double", 0.0),
    ("cost_unit_tax_in", "double", 0.0),
    ("cogs_tax_in", "double", 0.0),
    ("gross_profit", "double", 0.0),
    ("source_cost_move_id", "bigint", 0),
    ("source_cost_tax_id", "bigint", 0),
]

AGG_PROFIT_DAILY: Spec = [
    ("date", "date", None),
    ("revenue_tax_in", "double", 0.0),
    ("cogs_tax_in", "double", 0.0),
    ("gross_profit", "double", 0.0),
    ("quantity", "double", 0.0),
    ("transactions", "bigint", 0),
    ("lines", "bigint", 0),
]

AGG_PROFIT_DAILY_BY_PRODUCT: Spec = [
    ("date", "date", None),
    ("product_id", "bigint", 0),
    ("revenue_tax_in", "double", 0.0),
    ("cogs_tax_in", "double", 0.0),
    ("gross_profit", "double", 0.0),
    ("quantity", "double", 0.0),
    ("lines", "bigint", 0),
]

AGG_SALES_DAILY: Spec = [
    ("date", "date", None),
    ("revenue", "double", 0.0),
    ("transactions", "bigint", 0),
    ("items_sold", "double", 0.0),
    ("lines", "bigint", 0),
]

AGG_SALES_DAILY_BY_PRODUCT: Spec = [
    ("date", "date", None),
    ("product_id", "bigint", 0),
    ("revenue", "double", 0.0),
    ("quantity", "double", 0.0),
    ("lines", "bigint", 0),
]

AGG_SALES_DAILY_BY_PRINCIPAL: Spec = [
    ("date", "date", None),
    ("principal", "string", "Unknown"),
    ("revenue", "double", 0.0),
    ("quantity", "double", 0.0),
    ("lines", "bigint", 0),
]

# --- dimensions ------------------------------------------------------------------

DIM_PRODUCTS: Spec = [
    ("product_id", "bigint", None),
    ("product_name", "string", None),
    ("product_category", "string", None),
    ("product_parent_category", "string", None),
    ("product_brand", "string", None),
    ("product_brand_id", "bigint", None),
    ("product_barcode", "string", None),
    ("product_sku", "string", None),
]

DIM_LOCATIONS: Spec = [
    ("location_id", "bigint", None),
    ("location_name", "string", None),
    ("location_usage", "string", None),
    ("scrap_location", "boolean", False),
]

DIM_UOMS: Spec = [
    ("uom_id", "bigint", None),
    ("uom_name", "string", None),
    ("uom_category", "string", None),
]

DIM_PARTNERS: Spec = [
    ("partner_id", "bigint", None),
    ("partner_name", "string", None),
    ("partner_ref", "string", None),
    ("partner_email", "string", None),
    ("partner_phone", "string", None),
    ("is_company", "boolean", False),
]

DIM_USERS: Spec = [
    ("user_id", "bigint", None),
    ("user_name", "string", None),
    ("user_login", "string", None),
    ("partner_id", "bigint", None),
]

DIM_COMPANIES: Spec = [
    ("company_id", "bigint", None),
    ("company_name", "string", None),
    ("partner_id", "bigint", None),
]

DIM_LOTS: Spec = [
    ("lot_id", "bigint", None),
    ("lot_name", "string", None),
    ("product_id", "bigint", None),
]

# Table name in the lake -> column list.  Facts, costs and aggregates are stored
# by day; dimensions are one folder each.
RAW_TABLES: dict[str, Spec] = {
    "pos_order_lines": RAW_POS_LINES,
    "account_move_out_invoice_lines": RAW_INVOICE_LINES,
    "account_move_in_invoice_lines": RAW_INVOICE_LINES,
    "inventory_moves": RAW_INVENTORY_MOVES,
    "stock_quants": RAW_STOCK_QUANTS,
}

STOCK_CLOSES: Spec = [
    ("date", "date", None),
    ("product_id", "bigint", 0),
    ("on_hand_qty", "double", 0.0),
]

DAILY_TABLES: dict[str, Spec] = {
    "fact_sales": FACT_SALES,
    "fact_invoice_sales": FACT_INVOICE_SALES,
    "fact_purchases": FACT_PURCHASES,
    "fact_inventory_moves": FACT_INVENTORY_MOVES,
    "fact_stock_on_hand_snapshot": FACT_STOCK_SNAPSHOT,
    "fact_stock_ledger_close": STOCK_CLOSES,
    "fact_product_cost_events": COST_ROWS,
    "fact_product_cost_latest_daily": COST_ROWS,
    "fact_sales_lines_profit": PROFIT_LINES,
    "agg_profit_daily": AGG_PROFIT_DAILY,
    "agg_profit_daily_by_product": AGG_PROFIT_DAILY_BY_PRODUCT,
    "agg_sales_daily": AGG_SALES_DAILY,
    "agg_sales_daily_by_product": AGG_SALES_DAILY_BY_PRODUCT,
    "agg_sales_daily_by_principal": AGG_SALES_DAILY_BY_PRINCIPAL,
}

COST_TABLES: dict[str, Spec] = {
    "fact_product_beginning_costs": BEGINNING_COSTS,
    "fact_product_legacy_costs": LEGACY_COSTS,
}

DIMENSIONS: dict[str, Spec] = {
    "dim_products": DIM_PRODUCTS,
    "dim_locations": DIM_LOCATIONS,
    "dim_uoms": DIM_UOMS,
    "dim_partners": DIM_PARTNERS,
    "dim_users": DIM_USERS,
    "dim_companies": DIM_COMPANIES,
    "dim_lots": DIM_LOTS,
}


def struct_type(spec: Spec) -> T.StructType:
    """Column list as a Spark schema."""
    return T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind, _ in spec))


def column_names(spec: Spec) -> list[str]:
    return [name for name, _, _ in spec]
