"""SQL (DuckDB) definitions of the same retail tables, in dependency order."""

VIEWS: dict[str, str] = {}

VIEWS["order_lines"] = """
SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

VIEWS["fact_sales"] = """
SELECT o_orderdate + to_hours(o_orderkey % 24) AS date,
       o_orderkey AS order_id,
       CASE WHEN o_orderkey % 97 = 0 THEN '/' WHEN o_orderkey % 89 = 0 THEN NULL
            ELSE 'POS/' || o_orderkey END AS order_ref,
       o_orderkey % 4 + 1 AS pos_config_id,
       o_custkey % 50 AS cashier_id,
       o_custkey AS customer_id,
       '[]' AS payment_method_ids,
       l_orderkey * 10 + l_linenumber AS line_id,
       l_partkey AS product_id,
       l_quantity AS quantity,
       floor(l_extendedprice * (1 - l_discount)) AS revenue
FROM order_lines WHERE o_orderstatus <> 'P'
"""

VIEWS["fact_invoice_sales"] = """
SELECT CAST(o_orderdate AS DATE) AS date,
       o_orderkey AS move_id,
       CASE WHEN o_orderkey % 97 = 0 THEN '/' WHEN o_orderkey % 89 = 0 THEN NULL
            ELSE 'INV/' || o_orderkey END AS move_name,
       o_custkey AS customer_id,
       l_orderkey * 10 + l_linenumber AS move_line_id,
       l_partkey AS product_id,
       l_extendedprice / l_quantity / CAST(0.73 AS DOUBLE) AS price_unit,
       l_quantity AS quantity,
       CAST(CASE WHEN l_tax >= 0.05 THEN 7 ELSE 5 END AS BIGINT) AS tax_id
FROM order_lines WHERE o_orderstatus = 'P'
"""

VIEWS["raw_bills"] = """
SELECT l_orderkey AS move_id,
       'BILL/' || l_orderkey AS move_name,
       strftime(l_shipdate, '%Y-%m-%d') AS move_date,
       l_suppkey AS vendor_id,
       CASE WHEN l_suppkey % 10 = 0 THEN ' ' ELSE 'Vendor ' || l_suppkey END AS vendor_name,
       l_orderkey * 10 + l_linenumber AS move_line_id,
       l_partkey AS product_id,
       CASE WHEN l_discount >= 0.09 THEN -1 ELSE 1 END
         * (l_extendedprice / l_quantity / CAST(1.73 AS DOUBLE)) AS price_unit,
       l_quantity AS quantity,
       CAST(CASE WHEN l_tax >= 0.05 THEN 7 ELSE 5 END AS BIGINT) AS tax_id
FROM lineitem WHERE l_returnflag = 'N'
"""

VIEWS["fact_purchases"] = """
SELECT CAST(b.move_date AS DATE) AS date, b.move_id, b.move_name, b.vendor_id, b.vendor_name,
       CAST(NULL AS BIGINT) AS purchase_order_id, '' AS purchase_order_name,
       b.move_line_id, b.product_id, b.price_unit,
       CASE WHEN b.price_unit < 0 THEN 0.0
            ELSE b.price_unit * (1 + CASE WHEN t.gross <> 0 THEN t.discount / t.gross ELSE 0 END)
       END AS actual_price,
       b.quantity, b.tax_id, '' AS tax_name, '[]' AS tax_ids_json, FALSE AS is_free_item
FROM raw_bills b JOIN (
  SELECT move_id,
         sum(CASE WHEN price_unit >= 0 THEN price_unit * quantity ELSE 0 END) AS gross,
         sum(CASE WHEN price_unit < 0 THEN price_unit * quantity ELSE 0 END) AS discount
  FROM raw_bills GROUP BY move_id) t ON t.move_id = b.move_id
"""

VIEWS["fact_inventory_moves"] = """
SELECT l_shipdate AS date, l_orderkey AS move_id, l_partkey AS product_id,
       nullif(l_suppkey % 10, 0) AS location_src_id,
       l_partkey % 10 AS location_dest_id,
       l_quantity AS qty_moved,
       CASE l_returnflag || l_linestatus WHEN 'RF' THEN 'incoming' WHEN 'RO' THEN 'transfer'
            WHEN 'NF' THEN 'production_in' WHEN 'NO' THEN 'production_out'
            WHEN 'AF' THEN 'adjustment' END AS movement_type,
       l_returnflag || l_linestatus = 'AF' AS inventory_adjustment_flag
FROM lineitem
"""

VIEWS["stock_snapshots"] = """
SELECT CAST(DATE '1995-01-01' + to_months(CAST(k AS INTEGER)) AS DATE) AS snapshot_date,
       p_partkey AS product_id,
       CAST((p_partkey * 37 + k * 11) % 200 - 5 AS DOUBLE) AS quantity
FROM part, range(0, 80) AS m(k)
"""

VIEWS["cost_events"] = """
SELECT date, product_id,
       actual_price * CASE WHEN tax_id IN (5, 2) THEN 1.0 WHEN tax_id IN (7, 6) THEN 1.11
                           ELSE 1.0 END AS cost_unit_tax_in,
       move_id AS source_move_id, coalesce(tax_id, 0) AS source_tax_id
FROM fact_purchases
WHERE product_id IS NOT NULL AND product_id <> 0 AND actual_price > 0 AND quantity > 0
"""

VIEWS["legacy_costs"] = """
SELECT p_partkey AS product_id, p_retailprice * CAST(0.5 AS DOUBLE) AS cost_unit_tax_in,
       CAST(5 AS BIGINT) AS source_tax_id, DATE '1995-01-01' AS effective_date,
       'opening' AS cost_source, 3 AS priority, p_brand <> 'Brand#7' AS is_active
FROM part WHERE p_type IN ('STANDARD', 'SMALL')
UNION ALL
SELECT p_partkey, p_retailprice * CAST(0.55 AS DOUBLE), CAST(5 AS BIGINT), DATE '1996-01-01',
       'estimate', 2, p_brand <> 'Brand#7'
FROM part WHERE p_size > 40
"""

VIEWS["beginning_costs"] = """
SELECT p_partkey AS product_id, p_retailprice * CAST(0.5 AS DOUBLE) AS cost_unit_tax_in,
       CAST(5 AS BIGINT) AS source_tax_id, DATE '1995-01-01' AS effective_date,
       p_brand <> 'Brand#7' AS is_active
FROM part WHERE p_size <= 25
"""

VIEWS["ledger_opening"] = """
SELECT p_partkey AS product_id, CAST(p_size AS DOUBLE) AS qty FROM part WHERE p_type = 'PROMO'
"""

VIEWS["dim_products"] = """
SELECT p_partkey AS product_id, p_name AS product_name, p_type AS product_category,
       CASE WHEN p_size <= 25 THEN 'Small' ELSE 'Large' END AS product_parent_category,
       CASE WHEN p_brand = 'Brand#13' THEN '' ELSE p_brand END AS product_brand,
       lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS product_barcode,
       'SKU-' || p_partkey AS product_sku
FROM part WHERE p_size < 50
"""

VIEWS["sales_all"] = """
SELECT 'pos' AS channel, date AS sold_at, CAST(date AS DATE) AS date, order_id AS txn_id,
       line_id, product_id, revenue, quantity, order_ref
FROM fact_sales WHERE order_ref IS NULL OR order_ref <> '/'
UNION ALL
SELECT 'invoice', CAST(date AS TIMESTAMP), date, move_id, move_line_id, product_id,
       price_unit * quantity, quantity, move_name
FROM fact_invoice_sales WHERE move_name IS NULL OR move_name <> '/'
"""

VIEWS["agg_sales_daily"] = """
SELECT date, sum(revenue) AS revenue, count(DISTINCT channel || ':' || txn_id) AS transactions,
       sum(quantity) AS items_sold, count(*) AS lines
FROM sales_all GROUP BY date
"""

VIEWS["agg_sales_daily_by_product"] = """
SELECT date, product_id, sum(revenue) AS revenue, sum(quantity) AS quantity, count(*) AS lines
FROM sales_all GROUP BY date, product_id
"""

VIEWS["agg_sales_daily_by_principal"] = """
SELECT s.date,
       CASE WHEN p.product_brand IS NULL OR trim(p.product_brand) = '' THEN 'Unknown'
            ELSE p.product_brand END AS principal,
       sum(s.revenue) AS revenue, sum(s.quantity) AS quantity, count(*) AS lines
FROM sales_all s LEFT JOIN dim_products p ON p.product_id = s.product_id
GROUP BY 1, 2
"""

VIEWS["taxed_lines"] = """
SELECT 'pos' AS channel, CAST(date AS DATE) AS date, order_id AS txn_id, line_id, product_id,
       quantity, revenue AS revenue_tax_in
FROM fact_sales WHERE order_ref IS NULL OR order_ref <> '/'
UNION ALL
SELECT 'invoice', date, move_id, move_line_id, product_id, quantity,
       price_unit * quantity * CASE WHEN tax_id IN (7, 6) THEN 1.11 ELSE 1.0 END
FROM fact_invoice_sales WHERE move_name IS NULL OR move_name <> '/'
"""

# Purchase cost before legacy cost; the newest row of the day it was known.
VIEWS["cost_offers"] = """
SELECT product_id, 1 AS priority, date AS effective_date, source_move_id, cost_unit_tax_in,
       source_tax_id, 'latest_purchase' AS cost_source
FROM cost_events
UNION ALL
SELECT product_id, priority, effective_date, 0, cost_unit_tax_in, source_tax_id, cost_source
FROM legacy_costs WHERE is_active AND cost_unit_tax_in > 0
"""

VIEWS["product_day_costs"] = """
SELECT d.product_id, d.date, o.cost_unit_tax_in, o.source_tax_id, o.cost_source, o.effective_date
FROM (SELECT DISTINCT product_id, date FROM taxed_lines) d
JOIN cost_offers o ON o.product_id = d.product_id AND o.effective_date <= d.date
QUALIFY row_number() OVER (PARTITION BY d.product_id, d.date
  ORDER BY o.priority, o.effective_date DESC, o.source_move_id DESC,
           o.cost_unit_tax_in DESC, o.source_tax_id DESC, o.cost_source DESC) = 1
"""

VIEWS["profit_lines"] = """
SELECT s.channel, s.date, s.txn_id, s.line_id, s.product_id, s.quantity, s.revenue_tax_in,
       coalesce(c.cost_unit_tax_in, 0) AS cost_unit_tax_in,
       c.cost_unit_tax_in * s.quantity AS cogs_tax_in,
       s.revenue_tax_in - c.cost_unit_tax_in * s.quantity AS gross_profit,
       CAST(NULL AS BIGINT) AS source_cost_move_id,
       coalesce(c.source_tax_id, 0) AS source_cost_tax_id,
       c.cost_unit_tax_in IS NULL AS cost_missing
FROM taxed_lines s
LEFT JOIN product_day_costs c ON c.product_id = s.product_id AND c.date = s.date
"""

VIEWS["agg_profit_daily"] = """
SELECT date, sum(revenue_tax_in) AS revenue_tax_in, sum(cogs_tax_in) AS cogs_tax_in,
       sum(gross_profit) AS gross_profit, sum(quantity) AS quantity,
       count(DISTINCT channel || ':' || txn_id) AS transactions, count(*) AS lines,
       count(*) FILTER (WHERE cost_missing) AS cost_missing
FROM profit_lines GROUP BY date
"""

VIEWS["agg_profit_daily_by_product"] = """
SELECT date, product_id, sum(revenue_tax_in) AS revenue_tax_in, sum(cogs_tax_in) AS cogs_tax_in,
       sum(gross_profit) AS gross_profit, sum(quantity) AS quantity, count(*) AS lines
FROM profit_lines GROUP BY date, product_id
"""
