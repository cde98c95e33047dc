"""Record shaping, dimensions, cleaning and typed views."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from shelfledger.operators import cleaning, dimensions, shaping
from shelfledger.registry.core import register
from shelfledger.registry.tables import FIRST_DAY, LAST_DAY, Tables
from shelfledger.schemas import (
    AGG_SALES_DAILY_BY_PRODUCT,
    RAW_INVOICE_LINES,
    RAW_POS_LINES,
    column_names,
)
from shelfledger.sources import files, lake

# --- POS -----------------------------------------------------------------------------------

_STAGED_ORDERS = """
SELECT CASE WHEN o_orderkey % 500 = 7 THEN 'not a date'
            ELSE strftime(o_orderdate + to_hours(o_orderkey % 24), '%Y-%m-%d %H:%M:%S')
       END AS order_date,
       o_orderkey AS order_id,
       CASE WHEN o_orderkey % 97 = 0 THEN '/' WHEN o_orderkey % 89 = 0 THEN NULL
            ELSE 'POS/' || o_orderkey END AS order_ref,
       o_orderkey % 4 + 1 AS pos_config_id, o_custkey % 50 AS cashier_id,
       o_custkey AS customer_id, o_totalprice AS amount_total
FROM orders WHERE o_orderstatus <> 'P'
"""

_PAYMENTS = """
SELECT order_id, '[' || string_agg(CAST(method_id AS VARCHAR), ', ' ORDER BY method_id) || ']'
         AS payment_method_ids
FROM (SELECT DISTINCT l_orderkey AS order_id, l_suppkey % 5 + 1 AS method_id
      FROM lineitem WHERE l_returnflag <> 'R' AND l_extendedprice > 0)
GROUP BY order_id
"""


@register("payment_methods", _PAYMENTS)
def _(t: Tables):
    return shaping.payment_methods(t.staged_payments)


_POS_LINES = f"""
SELECT o.order_date, o.order_id, o.order_ref, o.pos_config_id, o.cashier_id, o.customer_id,
       o.amount_total, coalesce(m.payment_method_ids, '[]') AS payment_method_ids,
       l_orderkey * 10 + l_linenumber AS line_id, l_partkey AS product_id, l_quantity AS qty,
       l_extendedprice AS price_subtotal_incl,
       CASE WHEN l_discount > 0 THEN l_extendedprice * l_discount ELSE 0 END AS discount_amount,
       coalesce(p.product_brand, 'Unknown') AS product_brand,
       CAST(NULL AS BIGINT) AS product_brand_id, p.product_name, p.product_category,
       p.product_parent_category
FROM lineitem JOIN ({_STAGED_ORDERS}) o ON o.order_id = l_orderkey
LEFT JOIN ({_PAYMENTS}) m ON m.order_id = o.order_id
LEFT JOIN dim_products p ON p.product_id = l_partkey
WHERE l_partkey <> 0
"""


def _pos_lines(t: Tables):
    return shaping.pos_lines(
        t.staged_orders, t.staged_order_lines, t.staged_payments, t.raw_products
    )


@register("pos_lines", _POS_LINES, discount_amount=9)
def _(t: Tables):
    return _pos_lines(t)


@register(
    "clean_pos",
    f"""
SELECT try_cast(order_date AS TIMESTAMP) + INTERVAL 7 HOUR AS date, order_id, order_ref,
       pos_config_id, cashier_id, customer_id, payment_method_ids, line_id, product_id,
       qty AS quantity, price_subtotal_incl - discount_amount AS revenue
FROM ({_POS_LINES})
""",
    revenue=9,
)
def _(t: Tables):
    return cleaning.clean_pos(_pos_lines(t))


@register(
    "load_fact_sales",
    f"""
SELECT try_cast(order_date AS TIMESTAMP) + INTERVAL 7 HOUR AS date, order_id,
       coalesce(order_ref, '') AS order_ref, pos_config_id, cashier_id, customer_id,
       payment_method_ids, line_id, product_id, qty AS quantity,
       price_subtotal_incl - discount_amount AS revenue
FROM ({_POS_LINES})
""",
    revenue=9,
)
def _(t: Tables):
    return cleaning.load_fact(cleaning.clean_pos(_pos_lines(t)), "fact_sales")


_TEXT_LINES = """
SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
       CASE WHEN l_linenumber = 1 THEN 'line ' || l_linenumber
            ELSE CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) END AS line_id,
       CAST(l_partkey AS VARCHAR) AS product_id,
       CASE WHEN l_returnflag = 'R' THEN 'n/a' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
       END AS qty,
       CASE WHEN l_discount > 0 THEN '1' END AS discount_amount
FROM lineitem
"""


@register(
    "normalise_raw_pos_lines",
    f"""
SELECT CAST(NULL AS VARCHAR) AS order_date, CAST(order_id AS BIGINT) AS order_id,
       CAST(NULL AS VARCHAR) AS order_ref, CAST(NULL AS BIGINT) AS pos_config_id,
       CAST(NULL AS BIGINT) AS cashier_id, CAST(NULL AS BIGINT) AS customer_id,
       CAST(NULL AS DOUBLE) AS amount_total, '[]' AS payment_method_ids,
       TRY_CAST(line_id AS BIGINT) AS line_id, CAST(product_id AS BIGINT) AS product_id,
       TRY_CAST(qty AS DOUBLE) AS qty, CAST(NULL AS DOUBLE) AS price_subtotal_incl,
       coalesce(TRY_CAST(discount_amount AS DOUBLE), 0) AS discount_amount,
       CAST(NULL AS VARCHAR) AS product_brand, CAST(NULL AS BIGINT) AS product_brand_id,
       CAST(NULL AS VARCHAR) AS product_name, CAST(NULL AS VARCHAR) AS product_category,
       CAST(NULL AS VARCHAR) AS product_parent_category
FROM ({_TEXT_LINES})
""",
)
def _(t: Tables):
    text = t.given("lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.when(F.col("l_linenumber") == 1, F.lit("line 1"))
        .otherwise((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"))
        .alias("line_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.when(F.col("l_returnflag") == "R", F.lit("n/a"))
        .otherwise(F.col("l_quantity").cast("int").cast("string"))
        .alias("qty"),
        F.when(F.col("l_discount") > 0, F.lit("1")).alias("discount_amount"),
        F.col("l_tax").alias("not_in_schema"),
    )
    return shaping.normalise(text, RAW_POS_LINES)


# --- documents ------------------------------------------------------------------------------


def _document_sql(kind: str, status: str, role: str) -> str:
    return f"""
SELECT o_orderkey AS move_id,
       CASE WHEN o_orderkey % 97 = 0 THEN '/' WHEN o_orderkey % 89 = 0 THEN NULL
            ELSE 'DOC/' || o_orderkey END AS move_name,
       strftime(o_orderdate, '%Y-%m-%d') AS move_date,
       o_custkey AS {role}_id, 'Partner ' || o_custkey AS {role}_name,
       l_suppkey + 1000 AS purchase_order_id, 'PO' || l_suppkey AS purchase_order_name,
       l_orderkey * 10 + l_linenumber AS move_line_id, l_partkey AS product_id,
       l_extendedprice / l_quantity AS price_unit, l_quantity AS quantity,
       CAST(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 5 END AS BIGINT) AS tax_id,
       CASE l_returnflag WHEN 'R' THEN '[2, 7]' WHEN 'A' THEN '[5, 6]' ELSE '[]' END
         AS tax_ids_json
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderstatus = '{status}' AND o_orderpriority <> '5-LOW'  -- {kind}
  AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '2001-08-02'
"""


_OUT = _document_sql("out_invoice", "P", "customer")
_IN = _document_sql("in_invoice", "F", "vendor")


def _documents(t: Tables, kind: str, role: str):
    return shaping.invoice_lines(
        t.staged_documents, t.staged_document_lines, kind, role, FIRST_DAY, LAST_DAY
    )


@register("customer_invoice_lines", _OUT, price_unit=9)
def _(t: Tables):
    return _documents(t, "out_invoice", "customer")


@register("vendor_bill_lines", _IN, price_unit=9)
def _(t: Tables):
    return _documents(t, "in_invoice", "vendor")


@register(
    "normalise_raw_invoice_lines",
    f"""
SELECT move_id, move_name, move_date, customer_id, customer_name, CAST(NULL AS BIGINT) AS vendor_id,
       CAST(NULL AS VARCHAR) AS vendor_name, purchase_order_id, purchase_order_name, move_line_id,
       product_id, price_unit, quantity, tax_id, tax_ids_json
FROM ({_OUT})
""",
    price_unit=9,
)
def _(t: Tables):
    return shaping.normalise(_documents(t, "out_invoice", "customer"), RAW_INVOICE_LINES)


@register(
    "clean_invoices",
    f"""
SELECT CAST(move_date AS DATE) AS date, move_id, coalesce(move_name, '') AS move_name, customer_id,
       customer_name, move_line_id, product_id, price_unit, quantity, tax_id, tax_ids_json
FROM ({_OUT})
""",
    price_unit=9,
)
def _(t: Tables):
    return cleaning.clean_invoices(_documents(t, "out_invoice", "customer"))


@register(
    "load_fact_invoice_sales",
    f"""
SELECT CAST(move_date AS DATE) AS date, move_id, coalesce(move_name, '') AS move_name, customer_id,
       customer_name, move_line_id, product_id, price_unit, quantity, tax_id, tax_ids_json,
       FALSE AS is_free_item
FROM ({_OUT})
""",
    price_unit=9,
)
def _(t: Tables):
    clean = cleaning.clean_invoices(_documents(t, "out_invoice", "customer"))
    return cleaning.load_fact(clean, "fact_invoice_sales")


# --- inventory ---------------------------------------------------------------------------------

_LOCATIONS = """
SELECT CAST(n_nationkey AS BIGINT) AS location_id,
       CASE WHEN n_nationkey > 2 THEN 'WH/' || n_name ELSE n_name END AS location_name,
       CASE n_regionkey WHEN 0 THEN 'internal' WHEN 1 THEN 'supplier' WHEN 2 THEN 'customer'
            WHEN 3 THEN 'inventory' ELSE 'internal' END AS location_usage,
       n_nationkey % 8 = 0 AS scrap_location
FROM nation
"""

_MOVE_LINES = f"""
SELECT move_id, move_line_id, movement_date, product_id, location_src_id, location_dest_id,
       CASE WHEN src_in AND NOT dest_in THEN -abs(qty_done)
            WHEN NOT src_in AND dest_in THEN abs(qty_done) ELSE qty_done END AS qty_moved,
       uom_id,
       CASE WHEN dest_scrap THEN NULL WHEN raw_mo IS NOT NULL THEN 'production_out'
            WHEN prod_mo IS NOT NULL THEN 'production_in' WHEN touches THEN 'adjustment'
            WHEN code = 'incoming' THEN 'incoming' WHEN code = 'internal' THEN 'transfer'
       END AS movement_type,
       touches AND raw_mo IS NULL AND prod_mo IS NULL AS inventory_adjustment_flag,
       coalesce(raw_mo, prod_mo) AS manufacturing_order_id, picking_id, code AS picking_type_code,
       coalesce(nullif(p_name, ''), nullif(m_reference, ''), nullif(m_name, ''), origin)
         AS reference, origin AS origin_reference,
       CASE WHEN NOT src_in AND dest_in THEN p_partner END AS source_partner_id,
       CASE WHEN src_in AND NOT dest_in THEN p_partner END AS destination_partner_id,
       coalesce(line_uid, m_uid) AS created_by_user,
       coalesce(line_created, m_created) AS create_date
FROM (
  SELECT l_orderkey AS move_id, l_orderkey * 10 + l_linenumber AS move_line_id,
         strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS movement_date, l_partkey AS product_id,
         l_suppkey % 25 AS location_src_id, l_partkey % 25 AS location_dest_id,
         l_quantity AS qty_done, l_suppkey % 5 AS uom_id, l_orderkey AS picking_id,
         CASE WHEN l_linenumber > 1 THEN l_suppkey END AS line_uid,
         CASE WHEN l_linenumber > 1 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END
           AS line_created,
         m.o_custkey AS m_uid, strftime(m.o_orderdate, '%Y-%m-%d %H:%M:%S') AS m_created,
         'MOVE/' || m.o_orderkey AS m_name,
         CASE WHEN m.o_orderpriority = '1-URGENT' THEN '' ELSE 'REF/' || m.o_orderkey END
           AS m_reference,
         CASE WHEN m.o_orderpriority = '2-HIGH' THEN m.o_orderkey + 1 END AS raw_mo,
         CASE WHEN m.o_orderpriority = '3-MEDIUM' THEN m.o_orderkey + 2 END AS prod_mo,
         CASE WHEN p.o_orderpriority = '5-LOW' THEN '' ELSE 'PICK/' || p.o_orderkey END AS p_name,
         coalesce(CASE WHEN p.o_orderpriority <> '4-NOT SPECIFIED' THEN 'PO' || p.o_orderkey END,
                  'SO' || m.o_orderkey) AS origin,
         p.o_custkey AS p_partner,
         CASE coalesce(CASE WHEN p.o_orderpriority <> '4-NOT SPECIFIED'
                            THEN p.o_orderkey % 5 END, m.o_custkey % 5)
              WHEN 0 THEN 'incoming' WHEN 1 THEN 'internal' WHEN 2 THEN 'outgoing'
              WHEN 3 THEN 'mrp_operation' END AS code,
         s.location_usage = 'internal' AS src_in, d.location_usage = 'internal' AS dest_in,
         s.location_usage = 'inventory' OR d.location_usage = 'inventory' AS touches,
         d.scrap_location AS dest_scrap
  FROM lineitem
  JOIN orders m ON m.o_orderkey = l_orderkey AND m.o_orderstatus <> 'P'
  LEFT JOIN orders p ON p.o_orderkey = l_orderkey AND p.o_orderstatus = 'F'
  LEFT JOIN ({_LOCATIONS}) s ON s.location_id = l_suppkey % 25
  LEFT JOIN ({_LOCATIONS}) d ON d.location_id = l_partkey % 25
  WHERE l_discount > 0)
"""


def _move_lines(t: Tables):
    return shaping.move_lines(
        t.staged_move_lines,
        t.staged_moves,
        t.staged_pickings,
        t.staged_picking_types,
        dimensions.dim_locations(t.staged_locations),
    )


@register("inventory_move_lines", _MOVE_LINES)
def _(t: Tables):
    return _move_lines(t)


def _partners(t: Tables):
    return dimensions.dim_partners(
        t.given("customer").select(
            F.col("c_custkey").alias("partner_id"),
            F.col("c_name").alias("partner_name"),
            F.col("c_mktsegment").alias("partner_ref"),
            F.when(F.col("c_acctbal") > 0, F.lit(True)).alias("is_company"),
        )
    )


def _uoms(t: Tables):
    return dimensions.dim_uoms(
        t.given("region").select(
            F.col("r_regionkey").alias("uom_id"),
            F.col("r_name").alias("uom_name"),
            F.lit("Unit").alias("uom_category"),
        )
    )


_CLEAN_MOVES = f"""
SELECT v.movement_date AS date, v.move_id, v.move_line_id, v.product_id,
       coalesce(p.product_name, '') AS product_name,
       coalesce(p.product_brand, '') AS product_brand,
       v.location_src_id, coalesce(s.location_name, '') AS location_src_name,
       s.location_usage AS location_src_usage,
       v.location_dest_id, coalesce(d.location_name, '') AS location_dest_name,
       d.location_usage AS location_dest_usage,
       v.qty_moved, v.uom_id, coalesce(r_name, '') AS uom_name,
       CASE WHEN r_name IS NULL THEN '' ELSE 'Unit' END AS uom_category,
       v.movement_type, v.inventory_adjustment_flag, v.manufacturing_order_id, v.picking_id,
       v.picking_type_code, v.reference, v.origin_reference,
       v.source_partner_id, coalesce(sp.c_name, '') AS source_partner_name,
       v.destination_partner_id, coalesce(dp.c_name, '') AS destination_partner_name,
       v.created_by_user, v.create_date
FROM ({_MOVE_LINES}) v
LEFT JOIN dim_products p ON p.product_id = v.product_id
LEFT JOIN ({_LOCATIONS}) s ON s.location_id = v.location_src_id
LEFT JOIN ({_LOCATIONS}) d ON d.location_id = v.location_dest_id
LEFT JOIN region ON r_regionkey = v.uom_id
LEFT JOIN customer sp ON sp.c_custkey = v.source_partner_id
LEFT JOIN customer dp ON dp.c_custkey = v.destination_partner_id
"""


def _clean_moves(t: Tables):
    return cleaning.clean_moves(
        _move_lines(t),
        t.dim_products,
        dimensions.dim_locations(t.staged_locations),
        _uoms(t),
        _partners(t),
    )


@register("clean_inventory_moves", _CLEAN_MOVES)
def _(t: Tables):
    return _clean_moves(t)


@register(
    "load_fact_inventory_moves",
    f"""
SELECT * REPLACE (CAST(date AS TIMESTAMP) AS date, CAST(create_date AS TIMESTAMP) AS create_date,
                  coalesce(movement_type, '') AS movement_type,
                  coalesce(picking_type_code, '') AS picking_type_code,
                  coalesce(reference, '') AS reference,
                  coalesce(origin_reference, '') AS origin_reference)
FROM ({_CLEAN_MOVES})
""",
)
def _(t: Tables):
    return cleaning.load_fact(_clean_moves(t), "fact_inventory_moves")


_QUANTS = """
SELECT CAST('2000-06-30' AS DATE) AS snapshot_date, p_partkey AS quant_id,
       p_partkey AS product_id, p_partkey % 25 AS location_id,
       CASE WHEN p_size > 25 THEN p_partkey + 7 END AS lot_id, CAST(NULL AS BIGINT) AS owner_id,
       CAST(1 AS BIGINT) AS company_id, CAST(p_partkey % 40 - 5 AS DOUBLE) AS quantity,
       CAST(p_partkey % 3 AS DOUBLE) AS reserved_quantity
FROM part WHERE p_partkey % 40 - 5 <> 0
"""


@register(
    "quant_snapshot",
    f"""
SELECT * REPLACE ('2000-06-30' AS snapshot_date,
                  CASE WHEN quant_id IN (SELECT p_partkey FROM part WHERE p_size < 50)
                       THEN product_id END AS product_id)
FROM ({_QUANTS})
""",
)
def _(t: Tables):
    return shaping.quant_snapshot(t.staged_quants, date(2000, 6, 30))


@register(
    "clean_stock_quants",
    f"SELECT * FROM ({_QUANTS}) WHERE quant_id IN (SELECT p_partkey FROM part WHERE p_size < 50)",
)
def _(t: Tables):
    return cleaning.clean_quants(shaping.quant_snapshot(t.staged_quants, date(2000, 6, 30)))


# --- dimensions ----------------------------------------------------------------------------------


@register(
    "dim_products",
    """
SELECT p_partkey AS product_id, p_name AS product_name,
       CASE WHEN p_size < 49 THEN p_type END AS product_category,
       CASE WHEN p_size <= 25 THEN 'Small' WHEN p_size < 49 THEN 'Large' END
         AS product_parent_category,
       CASE WHEN p_brand = 'Brand#13' THEN 'Unknown' ELSE p_brand END AS product_brand,
       length(p_brand) AS product_brand_id,
       lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS product_barcode,
       'SKU-' || p_partkey AS product_sku
FROM part WHERE p_partkey <> 0
""",
)
def _(t: Tables):
    return dimensions.dim_products(t.staged_products)


@register("dim_locations", _LOCATIONS)
def _(t: Tables):
    return dimensions.dim_locations(t.staged_locations)


@register(
    "dim_uoms",
    """
SELECT CAST(r_regionkey AS BIGINT) AS uom_id, r_name AS uom_name, 'Unit' AS uom_category
FROM region
""",
)
def _(t: Tables):
    return _uoms(t)


@register(
    "dim_partners",
    """
SELECT c_custkey AS partner_id, c_name AS partner_name, c_mktsegment AS partner_ref,
       CAST(NULL AS VARCHAR) AS partner_email, CAST(NULL AS VARCHAR) AS partner_phone,
       c_acctbal > 0 AS is_company
FROM customer
""",
)
def _(t: Tables):
    return _partners(t)


@register(
    "dim_users",
    """
SELECT s_suppkey AS user_id, s_name AS user_name, lower(s_name) AS user_login,
       CAST(s_nationkey AS BIGINT) AS partner_id FROM supplier
""",
)
def _(t: Tables):
    return dimensions.dim_users(
        t.given("supplier").select(
            F.col("s_suppkey").alias("user_id"),
            F.col("s_name").alias("user_name"),
            F.lower("s_name").alias("user_login"),
            F.col("s_nationkey").alias("partner_id"),
        )
    )


@register(
    "dim_companies",
    """
SELECT CAST(n_nationkey AS BIGINT) AS company_id, n_name AS company_name,
       CAST(n_regionkey AS BIGINT) AS partner_id FROM nation
""",
)
def _(t: Tables):
    return dimensions.dim_companies(
        t.given("nation").select(
            F.col("n_nationkey").alias("company_id"),
            F.col("n_name").alias("company_name"),
            F.col("n_regionkey").alias("partner_id"),
        )
    )


@register(
    "dim_lots",
    """
SELECT p_partkey + 7 AS lot_id, 'LOT/' || p_partkey AS lot_name, p_partkey AS product_id FROM part
""",
)
def _(t: Tables):
    return dimensions.dim_lots(
        t.given("part").select(
            (F.col("p_partkey") + 7).alias("lot_id"),
            F.concat(F.lit("LOT/"), F.col("p_partkey").cast("string")).alias("lot_name"),
            F.col("p_partkey").alias("product_id"),
        )
    )


# --- typed views and CSV shapes ---------------------------------------------------------------------


@register(
    "typed_view_date_from_folders",
    """
SELECT date, product_id, revenue, quantity, CAST(0 AS BIGINT) AS lines
FROM agg_sales_daily_by_product
""",
    revenue=4,
)
def _(t: Tables):
    stored = t.agg_sales_by_product.select(
        "product_id",
        "revenue",
        F.col("quantity").cast("string").alias("quantity"),
        F.date_format("date", "yyyy").alias("year"),
        F.date_format("date", "MM").alias("month"),
        F.date_format("date", "dd").alias("day"),
    )
    view = lake.typed(stored, AGG_SALES_DAILY_BY_PRODUCT)
    return view.select(*column_names(AGG_SALES_DAILY_BY_PRODUCT))


@register(
    "beginning_costs_from_csv_rows",
    """
SELECT p_partkey AS product_id,
       p_retailprice * CASE WHEN p_size % 8 IN (7, 6) THEN 1.11 ELSE 1.0 END AS cost_unit_tax_in,
       CAST(p_size % 8 AS BIGINT) AS source_tax_id, DATE '2025-02-10' AS effective_date,
       TRUE AS is_active, coalesce(nullif(p_name, 'hot gear'), '') AS notes
FROM part WHERE p_partkey > 0
""",
    cost_unit_tax_in=6,
)
def _(t: Tables):
    rows = t.given("part").where(F.col("p_partkey") > 0)
    return files.beginning_costs(
        rows.select(
            F.col("p_partkey").cast("string").alias("product_id"),
            F.col("p_retailprice").cast("string").alias("cost_unit"),
            (F.col("p_size") % 8).cast("string").alias("purchase_tax_id"),
            F.nullif(F.col("p_name"), F.lit("hot gear")).alias("notes"),
        )
    )


@register(
    "ledger_baseline_from_cells",
    """
SELECT l_partkey AS product_id,
       sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS qty
FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_partkey
""",
)
def _(t: Tables):
    product = F.when(F.col("l_linestatus") == "F", F.col("l_partkey").cast("string")).otherwise("x")
    qty = F.when(F.col("l_returnflag") == "R", F.lit("n/a")).otherwise(
        F.col("l_quantity").cast("string")
    )
    cells = t.given("lineitem").select(
        F.concat_ws(",", F.lit("stock"), product, F.lit('"Shelf, upper"'), qty).alias("cell")
    )
    return files.ledger_baseline(cells)
