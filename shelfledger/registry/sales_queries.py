"""Sales aggregates and reports."""

from __future__ import annotations

from shelfledger.functions.calendar import preset_range
from shelfledger.operators import sales
from shelfledger.registry.core import register
from shelfledger.registry.tables import AS_OF, FIRST_DAY, HALF_START, LAST_DAY, Tables

RANGE = "date >= DATE '1995-01-01' AND date < DATE '2001-08-02'"


@register(
    "sales_lines_combined",
    """
SELECT channel, sold_at, date, txn_id, line_id, product_id, revenue, quantity, order_ref
FROM sales_all
""",
    revenue=4,
)
def _(t: Tables):
    return t.sales_all


@register("sales_daily", "SELECT * FROM agg_sales_daily", revenue=3)
def _(t: Tables):
    return t.agg_sales_daily


@register("sales_daily_by_product", "SELECT * FROM agg_sales_daily_by_product", revenue=3)
def _(t: Tables):
    return t.agg_sales_by_product


@register("sales_daily_by_principal", "SELECT * FROM agg_sales_daily_by_principal", revenue=3)
def _(t: Tables):
    return t.agg_sales_by_principal


_PRINCIPALS = f"""
SELECT principal, sum(revenue) AS revenue FROM agg_sales_daily_by_principal
WHERE {RANGE} GROUP BY principal
"""


@register(
    "sales_by_principal",
    f"{_PRINCIPALS} ORDER BY round(sum(revenue), 4) DESC, principal LIMIT 20",
    revenue=3,
)
def _(t: Tables):
    return sales.sales_by_principal(t.agg_sales_by_principal, FIRST_DAY, LAST_DAY)


@register(
    "principals_named",
    f"""
SELECT * FROM ({_PRINCIPALS} ORDER BY round(sum(revenue), 4) DESC, principal LIMIT 30)
WHERE principal NOT IN ('Unknown Principal', 'unknown principal', '', '-', 'None', 'null', 'NULL')
  AND length(trim(principal)) > 1
ORDER BY round(revenue, 4) DESC, principal LIMIT 20
""",
    revenue=3,
)
def _(t: Tables):
    top = sales.sales_by_principal(t.agg_sales_by_principal, FIRST_DAY, LAST_DAY, 30)
    return sales.named_principals(top)


def _trend_sql(unit: str) -> str:
    return f"""
SELECT CAST(c.d AS DATE) AS date, coalesce(sum(a.revenue), 0) AS revenue,
       CAST(coalesce(sum(a.transactions), 0) AS BIGINT) AS transactions,
       coalesce(sum(a.items_sold), 0) AS items_sold,
       CASE WHEN sum(a.transactions) > 0 THEN sum(a.revenue) / sum(a.transactions) ELSE 0 END
         AS avg_transaction_value
FROM generate_series(date_trunc('{unit}', TIMESTAMP '1995-01-01'),
                     date_trunc('{unit}', TIMESTAMP '2001-08-01'), INTERVAL 1 {unit}) AS c(d)
LEFT JOIN agg_sales_daily a ON a.date >= c.d AND a.date < c.d + INTERVAL 1 {unit}
GROUP BY c.d
"""


@register("sales_trend_daily", _trend_sql("day"), revenue=3, avg_transaction_value=3)
def _(t: Tables):
    return sales.sales_trend(t.agg_sales_daily, FIRST_DAY, LAST_DAY, "daily")


@register("sales_trend_weekly", _trend_sql("week"), revenue=3, avg_transaction_value=3)
def _(t: Tables):
    return sales.sales_trend(t.agg_sales_daily, FIRST_DAY, LAST_DAY, "weekly")


@register("sales_trend_monthly", _trend_sql("month"), revenue=3, avg_transaction_value=3)
def _(t: Tables):
    return sales.sales_trend(t.agg_sales_daily, FIRST_DAY, LAST_DAY, "monthly")


@register(
    "daily_transaction_counts", f"SELECT date, transactions FROM ({_trend_sql('day')})"
)
def _(t: Tables):
    return sales.daily_transactions(t.agg_sales_daily, FIRST_DAY, LAST_DAY)


@register(
    "hourly_pattern",
    """
SELECT CAST(h.hour AS INTEGER) AS hour, coalesce(s.revenue, 0) AS revenue,
       coalesce(s.transactions, 0) AS transactions
FROM range(7, 24) AS h(hour) LEFT JOIN (
  SELECT extract(hour FROM sold_at) AS hour, sum(revenue) AS revenue,
         coalesce(nullif(count(DISTINCT channel || ':' || txn_id), 0), count(*)) AS transactions
  FROM sales_all
  WHERE sold_at >= TIMESTAMP '1995-01-01' AND sold_at < TIMESTAMP '2001-08-02'
    AND extract(hour FROM sold_at) BETWEEN 7 AND 23
  GROUP BY 1) s ON s.hour = h.hour
""",
    revenue=3,
)
def _(t: Tables):
    return sales.hourly_pattern(t.sales_all, FIRST_DAY, LAST_DAY)


_HEAT = """
SELECT date, CAST(extract(hour FROM sold_at) AS INTEGER) AS hour, sum(revenue) AS revenue
FROM sales_all
WHERE sold_at >= TIMESTAMP '1995-01-01' AND sold_at < TIMESTAMP '2001-08-02'
  AND extract(hour FROM sold_at) BETWEEN 7 AND 23
GROUP BY 1, 2
"""


@register("hourly_heatmap", _HEAT, revenue=3)
def _(t: Tables):
    return sales.hourly_heatmap(t.sales_all, FIRST_DAY, LAST_DAY)


_HOURS = [f"h{hour:02d}" for hour in range(7, 24)]


@register(
    "hourly_heatmap_pivot",
    "SELECT date, "
    + ", ".join(
        f"coalesce(sum(revenue) FILTER (WHERE hour = {hour}), 0) AS h{hour:02d}"
        for hour in range(7, 24)
    )
    + f" FROM ({_HEAT}) GROUP BY date",
    **dict.fromkeys(_HOURS, 3),
)
def _(t: Tables):
    return sales.heatmap_pivot(sales.hourly_heatmap(t.sales_all, FIRST_DAY, LAST_DAY))


@register(
    "top_products",
    f"""
SELECT s.product_id, coalesce(p.product_name, 'Product ' || s.product_id) AS product_name,
       coalesce(p.product_category, 'Unknown Category') AS category,
       s.quantity_sold, s.total_unit_price
FROM (SELECT product_id, sum(quantity) AS quantity_sold, sum(revenue) AS total_unit_price
      FROM agg_sales_daily_by_product WHERE {RANGE}
      GROUP BY product_id ORDER BY round(total_unit_price, 4) DESC, product_id LIMIT 20) s
LEFT JOIN dim_products p ON p.product_id = s.product_id
""",
    total_unit_price=3,
)
def _(t: Tables):
    return sales.top_products(t.agg_sales_by_product, t.dim_products, FIRST_DAY, LAST_DAY)


@register(
    "revenue_comparison",
    """
WITH sums AS (
  SELECT coalesce(sum(revenue) FILTER (WHERE date >= DATE '1998-04-17'), 0) AS cur_revenue,
         CAST(coalesce(sum(transactions) FILTER (WHERE date >= DATE '1998-04-17'), 0) AS BIGINT)
           AS cur_transactions,
         coalesce(sum(items_sold) FILTER (WHERE date >= DATE '1998-04-17'), 0) AS cur_items_sold,
         coalesce(sum(revenue) FILTER (WHERE date < DATE '1998-04-17'), 0) AS prev_revenue,
         CAST(coalesce(sum(transactions) FILTER (WHERE date < DATE '1998-04-17'), 0) AS BIGINT)
           AS prev_transactions,
         coalesce(sum(items_sold) FILTER (WHERE date < DATE '1998-04-17'), 0) AS prev_items_sold
  FROM agg_sales_daily
  WHERE date >= DATE '1998-04-17' - CAST(DATE '2001-08-01' - DATE '1998-04-17' + 1 AS INTEGER)
    AND date < DATE '2001-08-02'),
atv AS (
  SELECT *, CASE WHEN cur_transactions <> 0 THEN cur_revenue / cur_transactions ELSE 0 END
              AS cur_avg_transaction_value,
            CASE WHEN prev_transactions <> 0 THEN prev_revenue / prev_transactions ELSE 0 END
              AS prev_avg_transaction_value
  FROM sums)
SELECT cur_revenue, cur_transactions, cur_items_sold, cur_avg_transaction_value,
       prev_revenue, prev_transactions, prev_items_sold, prev_avg_transaction_value,
       cur_revenue - prev_revenue AS revenue_delta,
       cur_transactions - prev_transactions AS transactions_delta,
       cur_items_sold - prev_items_sold AS items_sold_delta,
       cur_avg_transaction_value - prev_avg_transaction_value AS avg_transaction_value_delta,
       CASE WHEN prev_revenue <> 0 THEN (cur_revenue - prev_revenue) / prev_revenue * 100
            ELSE 0 END AS revenue_pct,
       CASE WHEN prev_transactions <> 0
            THEN (cur_transactions - prev_transactions) / prev_transactions * 100.0
            ELSE 0 END AS transactions_pct,
       CASE WHEN prev_items_sold <> 0
            THEN (cur_items_sold - prev_items_sold) / prev_items_sold * 100
            ELSE 0 END AS items_sold_pct,
       CASE WHEN prev_avg_transaction_value <> 0
            THEN (cur_avg_transaction_value - prev_avg_transaction_value)
                 / prev_avg_transaction_value * 100
            ELSE 0 END AS avg_transaction_value_pct
FROM atv
""",
    cur_revenue=0,
    prev_revenue=0,
    revenue_delta=0,
    cur_avg_transaction_value=3,
    prev_avg_transaction_value=3,
    avg_transaction_value_delta=3,
    revenue_pct=6,
    transactions_pct=6,
    items_sold_pct=6,
    avg_transaction_value_pct=6,
)
def _(t: Tables):
    return sales.revenue_comparison(t.agg_sales_daily, HALF_START, LAST_DAY)


_OVERVIEW = f"""
WITH base AS (
  SELECT a.revenue, a.quantity, coalesce(p.product_parent_category, 'Unknown') AS parent_category,
         coalesce(p.product_category, 'Unknown') AS category,
         coalesce(p.product_brand, 'Unknown') AS brand
  FROM agg_sales_daily_by_product a LEFT JOIN dim_products p ON p.product_id = a.product_id
  WHERE {RANGE})
SELECT NULL AS parent_category, NULL AS category, NULL AS brand, 'summary' AS type,
       sum(revenue) AS revenue, sum(quantity) AS quantity FROM base
UNION ALL
SELECT parent_category, category, NULL, 'cat', sum(revenue), NULL FROM base GROUP BY 1, 2
UNION ALL
SELECT parent_category, category, brand, 'brand', sum(revenue), NULL FROM base GROUP BY 1, 2, 3
"""


@register("overview_summary", _OVERVIEW, revenue=3)
def _(t: Tables):
    return sales.overview_summary(t.agg_sales_by_product, t.dim_products, FIRST_DAY, LAST_DAY)


@register(
    "parent_category_totals",
    f"""
SELECT parent_category, sum(revenue) AS revenue,
       sum(revenue) / sum(sum(revenue)) OVER () AS share
FROM ({_OVERVIEW}) WHERE type = 'cat' GROUP BY parent_category
""",
    revenue=0,
    share=8,
)
def _(t: Tables):
    return sales.parent_totals(
        sales.overview_summary(t.agg_sales_by_product, t.dim_products, FIRST_DAY, LAST_DAY)
    )


def _flow_sql(categories: int, brands: int) -> str:
    return f"""
WITH brands AS (SELECT * FROM ({_OVERVIEW}) WHERE type = 'brand'),
cats AS (SELECT parent_category, category, sum(revenue) AS total FROM brands GROUP BY 1, 2
         ORDER BY round(total, 4) DESC, 1, 2 LIMIT {categories}),
kept AS (SELECT b.* FROM brands b JOIN cats USING (parent_category, category)),
best AS (SELECT brand, sum(revenue) AS total FROM kept GROUP BY 1
         ORDER BY round(total, 4) DESC, 1 LIMIT {brands}),
chosen AS (SELECT * FROM kept WHERE brand IN (SELECT brand FROM best))
SELECT 'parent_category' AS level, parent_category, parent_category AS source,
       category AS target, sum(revenue) AS value
FROM chosen GROUP BY parent_category, category
UNION ALL
SELECT 'category_brand', parent_category, category, brand, revenue FROM chosen
"""


@register("category_flow", _flow_sql(20, 30), value=3)
def _(t: Tables):
    return sales.category_flow(
        sales.overview_summary(t.agg_sales_by_product, t.dim_products, FIRST_DAY, LAST_DAY)
    )


@register("category_flow_narrow", _flow_sql(5, 8), value=3)
def _(t: Tables):
    return sales.category_flow(
        sales.overview_summary(t.agg_sales_by_product, t.dim_products, FIRST_DAY, LAST_DAY),
        top_categories=5,
        top_brands=8,
    )


@register(
    "category_rollup",
    """
SELECT p.product_category, sum(s.revenue) AS revenue, count(DISTINCT s.order_id) AS orders
FROM fact_sales s JOIN dim_products p ON p.product_id = s.product_id
WHERE s.date >= TIMESTAMP '1995-01-01' AND s.revenue > 0 GROUP BY 1
""",
    revenue=3,
)
def _(t: Tables):
    return sales.category_rollup(t.fact_sales, t.dim_products, FIRST_DAY)


@register(
    "monthly_sales",
    """
SELECT CAST(date_trunc('month', date) AS DATE) AS month, sum(revenue) AS revenue,
       count(*) AS lines
FROM fact_sales WHERE date >= TIMESTAMP '1995-01-01' GROUP BY 1
""",
    revenue=3,
)
def _(t: Tables):
    return sales.monthly_sales(t.fact_sales, FIRST_DAY)


@register(
    "sales_range_totals",
    """
SELECT count(*) AS lines, coalesce(sum(revenue), 0) AS revenue FROM fact_sales
WHERE date >= TIMESTAMP '1995-01-01' AND date < TIMESTAMP '2001-08-02'
""",
    revenue=0,
)
def _(t: Tables):
    return sales.range_totals(t.fact_sales, FIRST_DAY, LAST_DAY)


@register(
    "sales_product_join_totals",
    """
SELECT count(*) AS lines, sum(s.revenue) AS revenue
FROM fact_sales s JOIN dim_products p ON p.product_id = s.product_id
WHERE s.date >= TIMESTAMP '1995-01-01'
""",
    revenue=0,
)
def _(t: Tables):
    return sales.product_join_totals(t.fact_sales, t.dim_products, FIRST_DAY)


def _preset(name: str, start: str, end: str) -> None:
    @register(
        f"sales_preset_{name}",
        f"""
SELECT CAST(c.d AS DATE) AS date, coalesce(a.revenue, 0) AS revenue,
       coalesce(a.transactions, 0) AS transactions, coalesce(a.items_sold, 0) AS items_sold,
       coalesce(a.revenue / a.transactions, 0) AS avg_transaction_value
FROM generate_series(CAST({start} AS TIMESTAMP), CAST({end} AS TIMESTAMP), INTERVAL 1 DAY) AS c(d)
LEFT JOIN agg_sales_daily a ON a.date = CAST(c.d AS DATE)
""",
        revenue=3,
        avg_transaction_value=3,
    )
    def _(t: Tables):
        return sales.sales_trend(t.agg_sales_daily, *preset_range(name, AS_OF))


_TODAY = "DATE '2000-06-30'"
_preset("weekly", f"{_TODAY} - 6", _TODAY)
_preset("monthly", f"date_trunc('month', {_TODAY})", _TODAY)
_preset("quarterly", f"date_trunc('quarter', {_TODAY})", _TODAY)
_preset(
    "semesterly",
    f"date_trunc('year', {_TODAY}) + to_months(6 * ((month({_TODAY}) - 1) // 6)::INTEGER)",
    _TODAY,
)
_preset("yearly", f"date_trunc('year', {_TODAY})", _TODAY)
_preset(
    "last_month",
    f"date_trunc('month', {_TODAY}) - INTERVAL 1 MONTH",
    f"date_trunc('month', {_TODAY}) - INTERVAL 1 DAY",
)
