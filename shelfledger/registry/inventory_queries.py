"""Stock, sell-through, ABC and action lists."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from shelfledger.operators import abc, actions, costs, sell_through, stock
from shelfledger.registry.core import register
from shelfledger.registry.tables import (
    AS_OF,
    BASELINE_LOCAL,
    EARLY_AS_OF,
    FIRST_DAY,
    HALF_START,
    LAST_DAY,
    POOL,
    SNAPSHOT_DAY,
    Tables,
)

RANGE = "date >= DATE '1995-01-01' AND date < DATE '2001-08-02'"

# --- stock ---------------------------------------------------------------------------------


@register(
    "snapshot_on_hand",
    """
SELECT product_id, sum(quantity) AS qty_on_hand FROM stock_snapshots
WHERE snapshot_date = DATE '2000-06-01' GROUP BY product_id
""",
)
def _(t: Tables):
    return stock.snapshot_on_hand(t.stock_snapshots, SNAPSHOT_DAY)


@register(
    "units_sold_by_product",
    f"""
SELECT product_id, sum(quantity) AS units_sold, sum(revenue) AS revenue
FROM agg_sales_daily_by_product WHERE {RANGE} GROUP BY product_id
""",
    revenue=3,
)
def _(t: Tables):
    return stock.units_sold(t.agg_sales_by_product, FIRST_DAY, LAST_DAY)


# Local 07:00 is 00:00 UTC in the stores' zone.
_DELTAS = """
SELECT product_id, sum(CASE
  WHEN location_dest_id IN (1, 2, 3) AND coalesce(location_src_id, -1) NOT IN (1, 2, 3)
    THEN abs(qty_moved)
  WHEN location_src_id IN (1, 2, 3) AND coalesce(location_dest_id, -1) NOT IN (1, 2, 3)
    THEN -abs(qty_moved)
  ELSE 0 END) AS qty_delta
FROM fact_inventory_moves
WHERE date > TIMESTAMP '1997-02-10 00:00:00' AND date <= TIMESTAMP '2000-06-30 00:00:00'
GROUP BY product_id
"""


@register("ledger_deltas", _DELTAS)
def _(t: Tables):
    return stock.ledger_deltas(
        t.fact_inventory_moves,
        stock.utc_of(BASELINE_LOCAL),
        stock.utc_of(datetime(2000, 6, 30, 7)),
        POOL,
    )


_LEDGER = f"""
SELECT l.product_id, coalesce(p.product_name, 'Product ' || l.product_id) AS product_name,
       coalesce(p.product_category, 'Unknown Category') AS product_category,
       coalesce(p.product_brand, 'Unknown Brand') AS product_brand,
       coalesce(p.product_barcode, '') AS product_barcode,
       coalesce(p.product_sku, '') AS product_sku,
       l.on_hand_qty, CAST(0 AS DOUBLE) AS reserved_qty, l.units_sold, l.avg_daily_sold,
       l.days_of_cover, coalesce(l.days_of_cover < 7, FALSE) AS low_stock_flag,
       l.on_hand_qty > 0 AND l.units_sold <= 0 AS dead_stock_flag
FROM (
  SELECT *, CASE WHEN avg_daily_sold > 0 THEN on_hand_qty / avg_daily_sold END AS days_of_cover
  FROM (
    SELECT product_id, coalesce(o.qty, 0) + coalesce(d.qty_delta, 0) AS on_hand_qty,
           coalesce(s.units_sold, 0) AS units_sold,
           coalesce(s.units_sold, 0) / CAST(30 AS DOUBLE) AS avg_daily_sold
    FROM ledger_opening o FULL OUTER JOIN ({_DELTAS}) d USING (product_id)
    LEFT JOIN (SELECT product_id, sum(quantity) AS units_sold FROM sales_all
               WHERE date > DATE '2000-06-30' - 30 AND date < DATE '2000-07-01'
               GROUP BY product_id) s USING (product_id))) l
LEFT JOIN dim_products p ON p.product_id = l.product_id
"""


def _ledger(t: Tables):
    return stock.ledger_stock(
        t.ledger_baseline,
        t.fact_inventory_moves,
        t.sales_all,
        t.dim_products,
        AS_OF,
        baseline_local=BASELINE_LOCAL,
        pool=POOL,
    )


@register("ledger_stock", _LEDGER, avg_daily_sold=8, days_of_cover=6)
def _(t: Tables):
    return _ledger(t)


@register(
    "ledger_stock_before_baseline",
    f"SELECT *, DATE '2000-06-30' AS as_of FROM ({_LEDGER})",
    avg_daily_sold=8,
    days_of_cover=6,
)
def _(t: Tables):
    """Two cutoffs in one result: the one before the opening stock has no rows, the other all."""
    early = stock.ledger_stock(
        t.ledger_baseline,
        t.fact_inventory_moves,
        t.sales_all,
        t.dim_products,
        EARLY_AS_OF,
        baseline_local=BASELINE_LOCAL,
        pool=POOL,
    )
    both = early.withColumn("as_of", F.lit(EARLY_AS_OF)).unionByName(
        _ledger(t).withColumn("as_of", F.lit(AS_OF))
    )
    return both


_CLOSES = [date(AS_OF.year, month, 1) for month in range(1, AS_OF.month + 1)]


@register("ledger_stock_from_close", _LEDGER, avg_daily_sold=8, days_of_cover=6)
def _(t: Tables):
    """Monthly closes of half a year, then the ledger from the last one and the days since."""
    closes = stock.ledger_closes(
        t.ledger_baseline, t.fact_inventory_moves, BASELINE_LOCAL, _CLOSES, POOL
    )
    last = closes.where(F.col("date") == F.lit(_CLOSES[-1]))
    return stock.ledger_stock(
        last.select("product_id", F.col("on_hand_qty").alias("qty")),
        t.fact_inventory_moves,
        t.sales_all,
        t.dim_products,
        AS_OF,
        baseline_local=stock.close_of(_CLOSES[-1]),
        pool=POOL,
    )


_TOTALS = """
SELECT sum(on_hand_qty) AS total_on_hand,
       count(*) FILTER (WHERE low_stock_flag) AS low_stock_count,
       count(*) FILTER (WHERE dead_stock_flag) AS dead_stock_count
"""


@register("stock_totals", f"{_TOTALS} FROM ({_LEDGER})")
def _(t: Tables):
    return stock.stock_totals(_ledger(t))


@register(
    "stock_totals_filtered",
    f"""{_TOTALS} FROM ({_LEDGER})
WHERE product_category IN ('PROMO', 'ECONOMY') AND product_brand IN ('Brand#1', 'Brand#2', 'Brand#5')
""",
)
def _(t: Tables):
    items = actions.apply_filters(
        _ledger(t), categories=["PROMO", "ECONOMY"], brands=["Brand#1", "Brand#2", "Brand#5"]
    )
    return stock.stock_totals(items)


@register(
    "stock_filter_barcode_vendor",
    f"""
SELECT * FROM ({_LEDGER})
WHERE contains(lower(product_barcode), '12')
  AND product_id IN (SELECT product_id FROM fact_purchases
                     WHERE vendor_id IN (3, 5, 8) AND coalesce(product_id, 0) <> 0)
""",
    avg_daily_sold=8,
    days_of_cover=6,
)
def _(t: Tables):
    return actions.apply_filters(
        _ledger(t), barcode=" 12 ", vendor_ids=[3, 5, 8], purchases=t.fact_purchases
    )


for _name, _condition in {
    "low": "low_stock_flag",
    "dead": "dead_stock_flag",
    "healthy": "NOT low_stock_flag AND NOT dead_stock_flag AND on_hand_qty > 0",
}.items():

    @register(
        f"stock_quick_filter_{_name}",
        f"SELECT * FROM ({_LEDGER}) WHERE {_condition}",
        avg_daily_sold=8,
        days_of_cover=6,
    )
    def _(t: Tables, name=_name):
        return stock.quick_filter(_ledger(t), name)


@register(
    "cover_histogram",
    f"""
WITH c AS (SELECT days_of_cover AS x FROM ({_LEDGER}) WHERE days_of_cover IS NOT NULL),
b AS (SELECT min(x) AS low, (max(x) - min(x)) / CAST(20 AS DOUBLE) AS width FROM c),
n AS (SELECT least(CASE WHEN width > 0 THEN CAST(floor((x - low) / width) AS INTEGER) ELSE 0 END,
                   19) AS bin, count(*) AS sku_count FROM c, b GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, low + g.bin * width AS cover_from,
       low + (g.bin + 1) * width AS cover_to, coalesce(n.sku_count, 0) AS sku_count
FROM range(0, 20) AS g(bin) CROSS JOIN b LEFT JOIN n ON n.bin = g.bin
""",
    cover_from=6,
    cover_to=6,
)
def _(t: Tables):
    return stock.cover_histogram(_ledger(t))


@register(
    "lowest_cover",
    f"""
SELECT product_id, product_name, on_hand_qty, days_of_cover FROM ({_LEDGER})
WHERE low_stock_flag ORDER BY days_of_cover, product_id LIMIT 10
""",
    days_of_cover=6,
)
def _(t: Tables):
    return stock.lowest_cover(_ledger(t))


_STATUS = """
SELECT *, on_hand_qty * CASE WHEN units_sold > 0 THEN revenue / units_sold ELSE 0 END
         AS est_stock_value
FROM (
  SELECT *, CASE WHEN units_sold = 0 THEN 'dead_stock' WHEN days_of_cover < 14 THEN 'low_stock'
                 WHEN days_of_cover > 90 THEN 'overstock' ELSE 'healthy' END AS stock_status
  FROM (
    SELECT *, CASE WHEN avg_daily_sold > 0 THEN on_hand_qty / avg_daily_sold
                   ELSE CAST(999999 AS DOUBLE) END AS days_of_cover
    FROM (
      SELECT q.product_id, q.on_hand_qty,
             coalesce(s.units_sold, 0) AS units_sold, coalesce(s.revenue, 0) AS revenue,
             coalesce(s.units_sold, 0) / CAST(120 AS DOUBLE) AS avg_daily_sold
      FROM (SELECT product_id, sum(quantity) AS on_hand_qty FROM stock_snapshots
            WHERE snapshot_date = DATE '2000-06-01' GROUP BY product_id) q
      LEFT JOIN (SELECT product_id, sum(quantity) AS units_sold, sum(revenue) AS revenue
                 FROM agg_sales_daily_by_product
                 WHERE date > DATE '2000-06-01' - 120 AND date < DATE '2000-06-02'
                 GROUP BY product_id) s
      ON s.product_id = q.product_id AND q.on_hand_qty <> 0)))
"""


def _status(t: Tables):
    return stock.stock_status(
        t.stock_snapshots, t.agg_sales_by_product, SNAPSHOT_DAY, lookback_days=120
    )


@register(
    "stock_status",
    _STATUS,
    revenue=3,
    avg_daily_sold=8,
    days_of_cover=6,
    est_stock_value=3,
)
def _(t: Tables):
    return _status(t)


@register(
    "inventory_summary_cards",
    f"""
SELECT count(*) AS total_sku_count, sum(est_stock_value) AS total_inventory_value,
       count(*) FILTER (WHERE stock_status = 'dead_stock') AS dead_stock_count,
       count(*) FILTER (WHERE stock_status = 'low_stock') AS low_stock_count,
       count(*) FILTER (WHERE stock_status = 'overstock') AS overstock_sku_count,
       coalesce(sum(est_stock_value) FILTER (WHERE stock_status = 'overstock'), 0)
         AS overstock_value
FROM ({_STATUS})
""",
    total_inventory_value=0,
    overstock_value=0,
)
def _(t: Tables):
    return stock.summary_cards(_status(t))


@register(
    "movement_breakdown",
    """
SELECT product_id,
       coalesce(sum(qty_moved) FILTER (WHERE movement_type IN ('incoming', 'production_in')), 0)
         AS units_received,
       coalesce(sum(qty_moved) FILTER (WHERE movement_type = 'incoming'), 0) AS units_incoming,
       coalesce(sum(qty_moved) FILTER (WHERE movement_type = 'production_in'), 0)
         AS units_production_in,
       coalesce(sum(qty_moved) FILTER (WHERE inventory_adjustment_flag), 0)
         AS units_adjustment_net,
       coalesce(sum(qty_moved) FILTER (WHERE movement_type = 'production_out'), 0)
         AS units_production_out,
       coalesce(sum(qty_moved) FILTER (WHERE movement_type = 'transfer'), 0) AS units_transfer_net
FROM fact_inventory_moves
WHERE date >= TIMESTAMP '1995-01-01' AND date < TIMESTAMP '2001-08-02' GROUP BY product_id
""",
)
def _(t: Tables):
    return stock.movement_breakdown(t.fact_inventory_moves, FIRST_DAY, LAST_DAY)


# --- sell-through ---------------------------------------------------------------------------

_SELL = """
WITH snap AS (
  SELECT (SELECT max(snapshot_date) FROM stock_snapshots WHERE snapshot_date <= DATE '1998-04-17')
           AS b,
         (SELECT max(snapshot_date) FROM stock_snapshots WHERE snapshot_date <= DATE '2001-08-01')
           AS e),
st AS (
  SELECT product_id, coalesce(bq, 0) AS begin_on_hand, coalesce(eq, 0) AS end_on_hand,
         coalesce(units_sold, 0) AS units_sold
  FROM (SELECT product_id, sum(quantity) AS bq FROM stock_snapshots, snap
        WHERE snapshot_date = b GROUP BY 1)
  FULL OUTER JOIN (SELECT product_id, sum(quantity) AS eq FROM stock_snapshots, snap
        WHERE snapshot_date = e GROUP BY 1) USING (product_id)
  FULL OUTER JOIN (SELECT product_id, sum(quantity) AS units_sold
        FROM agg_sales_daily_by_product
        WHERE date >= DATE '1998-04-17' AND date < DATE '2001-08-02' GROUP BY 1)
  USING (product_id)),
rec AS (SELECT *, greatest(end_on_hand - begin_on_hand + units_sold, 0) AS units_received FROM st)
SELECT r.product_id, coalesce(p.product_name, 'Product ' || r.product_id) AS product_name,
       coalesce(p.product_category, 'Unknown Category') AS product_category,
       coalesce(p.product_brand, 'Unknown Brand') AS product_brand,
       coalesce(p.product_barcode, '') AS product_barcode,
       coalesce(p.product_sku, '') AS product_sku,
       begin_on_hand, units_received, units_received AS units_incoming,
       CAST(0 AS DOUBLE) AS units_production_in, CAST(0 AS DOUBLE) AS units_adjustment_net,
       CAST(0 AS DOUBLE) AS units_production_out, CAST(0 AS DOUBLE) AS units_transfer_net,
       units_sold,
       CASE WHEN begin_on_hand + units_received > 0
            THEN units_sold / (begin_on_hand + units_received) ELSE 0 END AS sell_through
FROM rec r LEFT JOIN dim_products p ON p.product_id = r.product_id
"""


def _sell(t: Tables):
    return sell_through.sell_through(
        t.stock_snapshots, t.agg_sales_by_product, t.dim_products, HALF_START, LAST_DAY
    )


@register("sell_through", _SELL, sell_through=8)
def _(t: Tables):
    return _sell(t)


_SELL_ROLLUP = f"""
SELECT product_category, CASE WHEN grouping(product_category) = 1 THEN 'total'
                              ELSE 'category' END AS level,
       sum(begin_on_hand) AS begin_on_hand, sum(units_received) AS units_received,
       sum(units_sold) AS units_sold,
       CASE WHEN sum(begin_on_hand) + sum(units_received) > 0
            THEN sum(units_sold) / (sum(begin_on_hand) + sum(units_received)) ELSE 0 END
         AS sell_through
FROM ({_SELL}) GROUP BY ROLLUP (product_category)
"""


@register("sell_through_rollup", _SELL_ROLLUP, sell_through=8)
def _(t: Tables):
    return sell_through.sell_through_rollup(_sell(t))


@register(
    "sell_through_top_categories",
    f"""
SELECT product_category, begin_on_hand, units_received, units_sold, sell_through
FROM ({_SELL_ROLLUP}) WHERE level = 'category'
ORDER BY units_sold DESC, product_category LIMIT 4
""",
    sell_through=8,
)
def _(t: Tables):
    return sell_through.top_categories(sell_through.sell_through_rollup(_sell(t)), limit=4)


@register(
    "sell_through_most_sold",
    f"SELECT * FROM ({_SELL}) ORDER BY units_sold DESC, product_id LIMIT 500",
    sell_through=8,
)
def _(t: Tables):
    return sell_through.most_sold(_sell(t), limit=500)


@register(
    "sell_through_best_and_worst",
    f"""
WITH s AS (SELECT product_id, product_name, units_sold, sell_through FROM ({_SELL}))
SELECT * FROM (SELECT *, 'Top' AS "group" FROM s
               ORDER BY round(sell_through, 6) DESC, product_id LIMIT 10)
UNION ALL
SELECT * FROM (SELECT *, 'Bottom' AS "group" FROM s
               ORDER BY round(sell_through, 6), product_id LIMIT 10)
""",
    sell_through=8,
)
def _(t: Tables):
    return sell_through.best_and_worst(_sell(t))


# --- ABC -------------------------------------------------------------------------------------


def _abc_sql(first: str, after: str, a: float = 0.2, b: float = 0.5) -> str:
    return f"""
WITH s AS (SELECT product_id, sum(quantity) AS units_sold, sum(revenue) AS revenue
           FROM agg_sales_daily_by_product
           WHERE date >= DATE '{first}' AND date < DATE '{after}' GROUP BY product_id),
r AS (SELECT *, row_number() OVER w AS sku_rank, count(*) OVER () AS n,
             sum(revenue) OVER () AS total_revenue,
             sum(revenue) OVER (w ROWS UNBOUNDED PRECEDING) AS cumulative_revenue
      FROM s WINDOW w AS (ORDER BY round(revenue, 4) DESC, product_id)),
k AS (SELECT *, greatest(1, ceil(CAST({a} AS DOUBLE) * n)) AS a_cut,
             greatest(1, ceil(CAST({a} AS DOUBLE) * n), ceil(CAST({b} AS DOUBLE) * n)) AS b_cut
      FROM r)
SELECT k.product_id, coalesce(p.product_name, 'Product ' || k.product_id) AS product_name,
       coalesce(p.product_category, 'Unknown Category') AS product_category,
       coalesce(p.product_brand, 'Unknown Brand') AS product_brand,
       units_sold, revenue, revenue / total_revenue AS revenue_share, cumulative_revenue,
       cumulative_revenue / total_revenue AS cumulative_share, sku_rank,
       sku_rank / CAST(n AS DOUBLE) AS cumulative_sku_share,
       CASE WHEN sku_rank <= a_cut THEN 'A' WHEN sku_rank <= b_cut THEN 'B' ELSE 'C' END
         AS abc_class, total_revenue
FROM k LEFT JOIN dim_products p ON p.product_id = k.product_id
"""


_ABC = _abc_sql("1995-01-01", "2001-08-02")
_ABC_RECENT = _abc_sql("2000-04-01", "2000-07-01")
_ABC_DIGITS = {
    "revenue": 3,
    "revenue_share": 10,
    "cumulative_revenue": 0,
    "cumulative_share": 8,
    "cumulative_sku_share": 8,
    "total_revenue": 0,
}


def _abc(t: Tables):
    return abc.abc_classes(t.agg_sales_by_product, t.dim_products, FIRST_DAY, LAST_DAY)


@register("abc_classes", _ABC, **_ABC_DIGITS)
def _(t: Tables):
    return _abc(t)


@register(
    "abc_classes_custom_thresholds",
    _abc_sql("1995-01-01", "2001-08-02", a=0.05, b=0.0),
    **_ABC_DIGITS,
)
def _(t: Tables):
    return abc.abc_classes(
        t.agg_sales_by_product, t.dim_products, LAST_DAY, FIRST_DAY, a_share=0.05, b_share=-1
    )


@register(
    "abc_summary",
    f"""
SELECT abc_class, count(*) AS sku_count, sum(revenue) AS revenue,
       sum(revenue) / max(total_revenue) AS revenue_share
FROM ({_ABC}) GROUP BY abc_class
""",
    revenue=0,
    revenue_share=8,
)
def _(t: Tables):
    return abc.abc_summary(_abc(t))


_ABC_CATEGORY = f"""
SELECT product_category, abc_class, sum(revenue) AS revenue FROM ({_ABC}) GROUP BY 1, 2
"""


@register("abc_by_category", _ABC_CATEGORY, revenue=3)
def _(t: Tables):
    return abc.abc_by_category(_abc(t))


@register(
    "abc_pareto",
    f"""
SELECT sku_rank, product_id, product_name, revenue, cumulative_share
FROM ({_ABC}) WHERE sku_rank <= 50
""",
    revenue=3,
    cumulative_share=8,
)
def _(t: Tables):
    return abc.pareto(_abc(t), 50)


@register(
    "abc_mix_top_categories",
    f"""
WITH c AS ({_ABC_CATEGORY})
SELECT * FROM c WHERE product_category IN (
  SELECT product_category FROM c GROUP BY 1
  ORDER BY round(sum(revenue), 4) DESC, product_category LIMIT 3)
""",
    revenue=3,
)
def _(t: Tables):
    return abc.abc_mix(abc.abc_by_category(_abc(t)), 3)


# --- action lists ----------------------------------------------------------------------------

_COST = """
SELECT product_id, cost_unit_tax_in FROM cost_events WHERE date <= DATE '1996-06-30'
QUALIFY row_number() OVER (PARTITION BY product_id
  ORDER BY date DESC, source_move_id DESC, cost_unit_tax_in DESC) = 1
"""


@register(
    "cost_valuation",
    f"""
SELECT l.*, coalesce(c.cost_unit_tax_in, 0) AS cost_unit_tax_in,
       coalesce(c.cost_unit_tax_in, 0) * l.on_hand_qty AS est_stock_value
FROM ({_LEDGER}) l LEFT JOIN (
  SELECT * FROM ({_COST})
  UNION ALL
  SELECT product_id, cost_unit_tax_in FROM beginning_costs
  WHERE is_active AND cost_unit_tax_in > 0
    AND product_id NOT IN (SELECT product_id FROM ({_COST}))) c
ON c.product_id = l.product_id
""",
    avg_daily_sold=8,
    days_of_cover=6,
    cost_unit_tax_in=4,
    est_stock_value=3,
)
def _(t: Tables):
    unit_costs = costs.inventory_cost(t.cost_events, t.beginning_costs, EARLY_AS_OF)
    return actions.cost_valuation(_ledger(t), unit_costs)


_POSITION = f"""
SELECT *, cost_unit_tax_in * on_hand_qty AS est_stock_value FROM (
  SELECT l.*, coalesce(a.abc_class, 'C') AS abc_class, coalesce(a.revenue, 0) AS revenue,
         coalesce(c.cost_unit_tax_in, 0) AS cost_unit_tax_in,
         CAST(ceil(greatest(CAST(30 AS DOUBLE) * avg_daily_sold - on_hand_qty, 0)) AS BIGINT)
           AS reorder_qty
  FROM ({_LEDGER}) l
  LEFT JOIN ({_ABC_RECENT}) a ON a.product_id = l.product_id
  LEFT JOIN (
    SELECT product_id, cost_unit_tax_in FROM ({_COST.replace("1996-06-30", "2000-06-30")})
    UNION ALL
    SELECT product_id, cost_unit_tax_in FROM beginning_costs
    WHERE is_active AND cost_unit_tax_in > 0 AND product_id NOT IN (
      SELECT product_id FROM ({_COST.replace("1996-06-30", "2000-06-30")}))) c
  ON c.product_id = l.product_id)
"""
_POSITION_DIGITS = {
    "avg_daily_sold": 8,
    "days_of_cover": 6,
    "revenue": 3,
    "cost_unit_tax_in": 4,
    "est_stock_value": 3,
}


def _position(t: Tables):
    recent = abc.abc_classes(t.agg_sales_by_product, t.dim_products, date(2000, 4, 1), AS_OF)
    unit_costs = costs.inventory_cost(t.cost_events, t.beginning_costs, AS_OF)
    return actions.stock_position(_ledger(t), recent, unit_costs)


_REORDER = """
abc_class IN ('A', 'B') AND ((days_of_cover IS NOT NULL AND days_of_cover < 14)
  OR (on_hand_qty <= 0 AND avg_daily_sold > 0))
"""
_MARKDOWN = """
abc_class = 'C' AND on_hand_qty > 0
  AND (days_of_cover > 90 OR days_of_cover IS NULL OR dead_stock_flag)
"""
_TOP = "abc_class = 'A' AND NOT low_stock_flag AND NOT dead_stock_flag AND on_hand_qty > 0"


@register("stock_position", _POSITION, **_POSITION_DIGITS)
def _(t: Tables):
    return _position(t)


@register("reorder_list", f"SELECT * FROM ({_POSITION}) WHERE {_REORDER}", **_POSITION_DIGITS)
def _(t: Tables):
    return actions.reorder_list(_position(t))


@register("markdown_list", f"SELECT * FROM ({_POSITION}) WHERE {_MARKDOWN}", **_POSITION_DIGITS)
def _(t: Tables):
    return actions.markdown_list(_position(t))


@register("top_performers", f"SELECT * FROM ({_POSITION}) WHERE {_TOP}", **_POSITION_DIGITS)
def _(t: Tables):
    return actions.top_performers(_position(t))


@register(
    "action_summary",
    f"""
SELECT count(*) FILTER (WHERE {_REORDER}) + count(*) FILTER (WHERE {_MARKDOWN})
         AS attention_count,
       coalesce(sum(revenue) FILTER (WHERE {_REORDER}), 0) AS revenue_at_risk,
       coalesce(sum(est_stock_value) FILTER (WHERE {_MARKDOWN}), 0) AS capital_locked,
       count(*) FILTER (WHERE NOT coalesce({_REORDER}, FALSE)
                          AND NOT coalesce({_MARKDOWN}, FALSE) AND on_hand_qty > 0)
         AS healthy_count,
       coalesce(sum(est_stock_value) FILTER (WHERE days_of_cover > 90), 0) AS overstock_value,
       count(*) FILTER (WHERE days_of_cover > 90) AS overstock_sku_count,
       count(*) FILTER (WHERE low_stock_flag) AS low_stock_count,
       count(*) FILTER (WHERE dead_stock_flag) AS dead_stock_count,
       sum(est_stock_value) AS total_inventory_value, count(*) AS total_sku_count
FROM ({_POSITION})
""",
    revenue_at_risk=3,
    capital_locked=0,
    overstock_value=0,
    total_inventory_value=0,
)
def _(t: Tables):
    return actions.action_summary(_position(t))


@register(
    "filter_options",
    """
SELECT DISTINCT 'category' AS kind, product_category AS value, product_category AS label
FROM dim_products WHERE coalesce(product_category, '') <> ''
UNION ALL
SELECT DISTINCT 'brand', product_brand, product_brand
FROM dim_products WHERE coalesce(product_brand, '') <> ''
UNION ALL
SELECT DISTINCT 'distributor', CAST(vendor_id AS VARCHAR),
       coalesce(nullif(trim(vendor_name), ''), CAST(vendor_id AS VARCHAR))
FROM fact_purchases WHERE coalesce(vendor_id, 0) <> 0
""",
)
def _(t: Tables):
    return actions.filter_options(t.dim_products, t.fact_purchases)


@register(
    "vendor_products",
    """
SELECT DISTINCT product_id FROM fact_purchases
WHERE vendor_id IN (3, 5, 8) AND coalesce(product_id, 0) <> 0
""",
)
def _(t: Tables):
    return actions.vendor_products(t.fact_purchases, [3, 5, 8])
