"""Line profit, profit aggregates and profit reports."""

from __future__ import annotations

from shelfledger.operators import costs, profit
from shelfledger.registry.core import register
from shelfledger.registry.cost_queries import _AS_OF_COST
from shelfledger.registry.tables import AS_OF, FIRST_DAY, HALF_START, LAST_DAY, Tables

RANGE = "date >= DATE '1995-01-01' AND date < DATE '2001-08-02'"
_MONEY = {
    "revenue_tax_in": 4,
    "cost_unit_tax_in": 4,
    "cogs_tax_in": 4,
    "gross_profit": 4,
}
_SUMS = {"revenue_tax_in": 3, "cogs_tax_in": 3, "gross_profit": 3}


@register(
    "line_profit_one_cost_date",
    """
SELECT s.channel, s.date, s.txn_id, s.line_id, s.product_id, s.quantity, s.revenue_tax_in,
       coalesce(c.cost_unit_tax_in, 0) AS cost_unit_tax_in,
       c.cost_unit_tax_in * s.quantity AS cogs_tax_in,
       s.revenue_tax_in - c.cost_unit_tax_in * s.quantity AS gross_profit,
       CAST(NULL AS BIGINT) AS source_cost_move_id,
       coalesce(c.source_tax_id, 0) AS source_cost_tax_id,
       c.cost_unit_tax_in IS NULL AS cost_missing
FROM taxed_lines s LEFT JOIN (
  SELECT * FROM cost_offers WHERE effective_date <= DATE '2000-06-30'
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY priority, effective_date DESC,
    source_move_id DESC, cost_unit_tax_in DESC, source_tax_id DESC, cost_source DESC) = 1) c
ON c.product_id = s.product_id
""",
    **_MONEY,
)
def _(t: Tables):
    unified = costs.unified_cost(t.cost_events, t.legacy_costs, AS_OF)
    return profit.line_profit(t.taxed_lines, unified)


@register("line_profit", "SELECT * FROM profit_lines", **_MONEY)
def _(t: Tables):
    return t.profit_lines


@register("line_profit_in_intervals", "SELECT * FROM profit_lines", **_MONEY)
def _(t: Tables):
    intervals = costs.unified_cost_intervals(t.cost_events, t.legacy_costs)
    return profit.line_profit_in_intervals(t.taxed_lines, intervals, FIRST_DAY, LAST_DAY)


@register(
    "line_profit_as_of",
    f"""
SELECT s.channel, s.date, s.txn_id, s.line_id, s.product_id, s.quantity, s.revenue_tax_in,
       coalesce(c.cost_unit_tax_in, 0) AS cost_unit_tax_in,
       coalesce(c.cost_unit_tax_in, 0) * s.quantity AS cogs_tax_in,
       s.revenue_tax_in - coalesce(c.cost_unit_tax_in, 0) * s.quantity AS gross_profit,
       CAST(NULL AS BIGINT) AS source_cost_move_id,
       coalesce(c.source_tax_id, 0) AS source_cost_tax_id,
       c.cost_unit_tax_in IS NULL AS cost_missing
FROM taxed_lines s LEFT JOIN ({_AS_OF_COST}) c
ON c.product_id = s.product_id AND c.date = s.date
""",
    **_MONEY,
)
def _(t: Tables):
    return profit.line_profit_as_of(t.taxed_lines, t.cost_events, zero_missing_cost=True)


@register("profit_daily", "SELECT * FROM agg_profit_daily", **_SUMS)
def _(t: Tables):
    return t.agg_profit_daily


@register("profit_daily_by_product", "SELECT * FROM agg_profit_daily_by_product", **_SUMS)
def _(t: Tables):
    return t.agg_profit_by_product


@register(
    "profit_summary",
    f"""
SELECT sum(revenue_tax_in) AS revenue, sum(cogs_tax_in) AS cogs, sum(gross_profit) AS gross_profit,
       sum(quantity) AS quantity, CAST(sum(transactions) AS BIGINT) AS transactions,
       CAST(sum(lines) AS BIGINT) AS lines,
       CASE WHEN sum(transactions) > 0 THEN sum(revenue_tax_in) / sum(transactions) ELSE 0 END
         AS avg_transaction_value,
       CASE WHEN sum(revenue_tax_in) > 0 THEN sum(gross_profit) / sum(revenue_tax_in) * 100
            ELSE 0 END AS gross_margin_pct
FROM agg_profit_daily WHERE {RANGE}
""",
    revenue=0,
    cogs=0,
    gross_profit=0,
    avg_transaction_value=3,
    gross_margin_pct=6,
)
def _(t: Tables):
    return profit.profit_summary(t.agg_profit_daily, FIRST_DAY, LAST_DAY)


def _trend_sql(unit: str) -> str:
    return f"""
SELECT CAST(c.d + INTERVAL 1 {unit} AS DATE) AS date,
       coalesce(sum(a.revenue_tax_in), 0) AS revenue, coalesce(sum(a.cogs_tax_in), 0) AS cogs,
       coalesce(sum(a.gross_profit), 0) AS gross_profit,
       coalesce(sum(a.quantity), 0) AS items_sold,
       CAST(coalesce(sum(a.transactions), 0) AS BIGINT) AS transactions,
       CAST(coalesce(sum(a.lines), 0) AS BIGINT) AS lines,
       CASE WHEN sum(a.transactions) > 0 THEN sum(a.revenue_tax_in) / sum(a.transactions)
            ELSE 0 END AS avg_transaction_value,
       coalesce(CASE WHEN sum(a.revenue_tax_in) > 0
            THEN sum(a.gross_profit) / sum(a.revenue_tax_in) * 100 ELSE 0 END, 0)
         AS gross_margin_pct
FROM generate_series(date_trunc('{unit}', TIMESTAMP '1995-01-01'),
                     date_trunc('{unit}', TIMESTAMP '2001-08-01'), INTERVAL 1 {unit}) AS c(d)
LEFT JOIN agg_profit_daily a ON a.date >= c.d AND a.date < c.d + INTERVAL 1 {unit}
GROUP BY c.d
"""


_TREND = {
    "revenue": 3,
    "cogs": 3,
    "gross_profit": 3,
    "avg_transaction_value": 3,
    "gross_margin_pct": 6,
}


@register("profit_trend_daily", _trend_sql("day"), **_TREND)
def _(t: Tables):
    return profit.profit_trend(t.agg_profit_daily, FIRST_DAY, LAST_DAY, "daily")


@register("profit_trend_weekly", _trend_sql("week"), **_TREND)
def _(t: Tables):
    return profit.profit_trend(t.agg_profit_daily, FIRST_DAY, LAST_DAY, "weekly")


@register("profit_trend_monthly", _trend_sql("month"), **_TREND)
def _(t: Tables):
    return profit.profit_trend(t.agg_profit_daily, FIRST_DAY, LAST_DAY, "monthly")


@register(
    "profit_by_product",
    f"""
SELECT s.product_id, coalesce(p.product_name, 'Product ' || s.product_id) AS product_name,
       coalesce(p.product_category, 'Unknown Category') AS category,
       s.total_revenue, s.total_cogs, s.total_profit, s.total_quantity,
       CAST(s.total_lines AS BIGINT) AS total_lines,
       CASE WHEN s.total_revenue > 0 THEN s.total_profit / s.total_revenue * 100 ELSE 0 END
         AS profit_margin_pct
FROM (SELECT product_id, sum(revenue_tax_in) AS total_revenue, sum(cogs_tax_in) AS total_cogs,
             sum(gross_profit) AS total_profit, sum(quantity) AS total_quantity,
             sum(lines) AS total_lines
      FROM agg_profit_daily_by_product WHERE {RANGE} GROUP BY product_id
      ORDER BY round(total_profit, 4) DESC NULLS LAST, product_id LIMIT 20) s
LEFT JOIN dim_products p ON p.product_id = s.product_id
""",
    total_revenue=3,
    total_cogs=3,
    total_profit=3,
    profit_margin_pct=6,
)
def _(t: Tables):
    return profit.profit_by_product(t.agg_profit_by_product, t.dim_products, FIRST_DAY, LAST_DAY)


_DRILL = """
SELECT date, txn_id, line_id, product_id, quantity, revenue_tax_in, cost_unit_tax_in, cogs_tax_in,
       gross_profit, CASE WHEN revenue_tax_in > 0 THEN gross_profit * 100 / revenue_tax_in
                          ELSE 0 END AS profit_margin_pct
FROM profit_lines
"""
_DRILL_DIGITS = {**_MONEY, "profit_margin_pct": 6}


@register("profit_drilldown", f"{_DRILL} WHERE {RANGE}", **_DRILL_DIGITS)
def _(t: Tables):
    return profit.profit_drilldown(t.profit_lines, FIRST_DAY, LAST_DAY)


@register(
    "profit_drilldown_product", f"{_DRILL} WHERE {RANGE} AND product_id = 42", **_DRILL_DIGITS
)
def _(t: Tables):
    return profit.profit_drilldown(t.profit_lines, FIRST_DAY, LAST_DAY, product_id=42)


@register(
    "profit_revenue_by_category",
    f"""
SELECT coalesce(p.product_parent_category, 'Unknown') AS parent_category,
       coalesce(p.product_category, 'Unknown') AS category, sum(s.revenue_tax_in) AS revenue
FROM agg_profit_daily_by_product s LEFT JOIN dim_products p ON p.product_id = s.product_id
WHERE {RANGE} GROUP BY 1, 2
""",
    revenue=3,
)
def _(t: Tables):
    return profit.profit_revenue_by_category(
        t.agg_profit_by_product, t.dim_products, FIRST_DAY, LAST_DAY
    )


@register(
    "executive_kpis",
    """
WITH sums AS (
  SELECT coalesce(sum(revenue_tax_in) FILTER (WHERE cur), 0) AS cur_revenue,
         coalesce(sum(cogs_tax_in) FILTER (WHERE cur), 0) AS cur_cogs,
         coalesce(sum(gross_profit) FILTER (WHERE cur), 0) AS cur_gross_profit,
         CAST(coalesce(sum(transactions) FILTER (WHERE cur), 0) AS BIGINT) AS cur_transactions,
         coalesce(sum(revenue_tax_in) FILTER (WHERE NOT cur), 0) AS prev_revenue,
         coalesce(sum(cogs_tax_in) FILTER (WHERE NOT cur), 0) AS prev_cogs,
         coalesce(sum(gross_profit) FILTER (WHERE NOT cur), 0) AS prev_gross_profit,
         CAST(coalesce(sum(transactions) FILTER (WHERE NOT cur), 0) AS BIGINT)
           AS prev_transactions
  FROM (SELECT *, date >= DATE '1998-04-17' AS cur FROM agg_profit_daily
        WHERE date >= DATE '1998-04-17'
                      - CAST(DATE '2001-08-01' - DATE '1998-04-17' + 1 AS INTEGER)
          AND date < DATE '2001-08-02')),
margins AS (
  SELECT *, CASE WHEN cur_revenue > 0 THEN cur_gross_profit / cur_revenue * 100 ELSE 0 END
              AS cur_margin_pct,
            CASE WHEN prev_revenue > 0 THEN prev_gross_profit / prev_revenue * 100 ELSE 0 END
              AS prev_margin_pct
  FROM sums)
SELECT *,
       CASE WHEN cur_transactions > 0 THEN cur_revenue / cur_transactions ELSE 0 END
         AS cur_avg_transaction_value,
       cur_revenue - prev_revenue AS revenue_delta,
       CASE WHEN prev_revenue <> 0 THEN (cur_revenue - prev_revenue) / prev_revenue * 100 END
         AS revenue_delta_pct,
       CASE WHEN cur_revenue > 0 THEN cur_cogs / cur_revenue * 100 ELSE 0 END AS cogs_pct,
       cur_margin_pct - prev_margin_pct AS margin_change,
       CASE WHEN prev_margin_pct <> 0
            THEN (cur_margin_pct - prev_margin_pct) / prev_margin_pct * 100 ELSE 0 END
         AS margin_change_pct
FROM margins
""",
    cur_revenue=0,
    cur_cogs=0,
    cur_gross_profit=0,
    prev_revenue=0,
    prev_cogs=0,
    prev_gross_profit=0,
    cur_margin_pct=6,
    prev_margin_pct=6,
    cur_avg_transaction_value=3,
    revenue_delta=0,
    revenue_delta_pct=6,
    cogs_pct=6,
    margin_change=6,
    margin_change_pct=6,
)
def _(t: Tables):
    return profit.executive_kpis(t.agg_profit_daily, HALF_START, LAST_DAY)
