"""Cost events, snapshots, history and unified costs."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from shelfledger.functions.columns import tax_multiplier
from shelfledger.operators import cleaning, costs
from shelfledger.registry.core import register
from shelfledger.registry.tables import AS_OF, EARLY_AS_OF, Tables

# First and last day of the daily cost history that is written out.
HISTORY_START = date(2000, 4, 1)


@register(
    "tax_multiplier",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey % 10 AS tax_id,
       CASE WHEN l_suppkey % 10 IN (7, 6) THEN CAST(1.11 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END
         AS multiplier
FROM lineitem
""",
)
def _(t: Tables):
    tax_id = F.col("l_suppkey") % 10
    return t.given("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        tax_id.alias("tax_id"),
        tax_multiplier(tax_id).alias("multiplier"),
    )


@register(
    "bill_discount_allocation",
    """
SELECT date, move_id, move_name, vendor_id, vendor_name, purchase_order_id, purchase_order_name,
       move_line_id, product_id, price_unit, actual_price, quantity, tax_id, tax_ids_json
FROM fact_purchases
""",
    price_unit=4,
    actual_price=4,
)
def _(t: Tables):
    return cleaning.clean_bills(t.raw_bills)


@register("fact_purchases", "SELECT * FROM fact_purchases", price_unit=4, actual_price=4)
def _(t: Tables):
    return t.fact_purchases


@register("cost_events", "SELECT * FROM cost_events", cost_unit_tax_in=4)
def _(t: Tables):
    return t.cost_events


_NEWEST = "source_move_id DESC, cost_unit_tax_in DESC, source_tax_id DESC"


@register(
    "cost_latest_by_product",
    f"""
SELECT product_id, cost_unit_tax_in, source_move_id, source_tax_id FROM cost_events
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY {_NEWEST}) = 1
""",
    cost_unit_tax_in=4,
)
def _(t: Tables):
    return costs.latest_cost_by_product(t.cost_events)


@register(
    "cost_latest_by_day",
    f"""
SELECT date, product_id, cost_unit_tax_in, source_move_id, source_tax_id FROM cost_events
QUALIFY row_number() OVER (PARTITION BY product_id, date ORDER BY {_NEWEST}) = 1
""",
    cost_unit_tax_in=4,
)
def _(t: Tables):
    return costs.latest_cost_by_day(t.cost_events)


def _snapshot_sql(day: str) -> str:
    return f"""
SELECT DATE '{day}' AS date, product_id, cost_unit_tax_in, source_move_id, source_tax_id
FROM cost_events WHERE date <= DATE '{day}'
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY date DESC, {_NEWEST}) = 1
"""


@register("cost_snapshot", _snapshot_sql("2000-06-30"), cost_unit_tax_in=4)
def _(t: Tables):
    return costs.cost_snapshot(t.cost_events, AS_OF)


@register("cost_snapshot_incremental", _snapshot_sql("2000-06-30"), cost_unit_tax_in=4)
def _(t: Tables):
    yesterday = costs.cost_snapshot(t.cost_events, AS_OF - timedelta(days=1))
    today = t.cost_events.where(F.col("date") == F.lit(AS_OF))
    return costs.cost_snapshot_next(yesterday, today, AS_OF)


@register(
    "cost_history_daily",
    f"""
SELECT CAST(c.d AS DATE) AS date, e.product_id, e.cost_unit_tax_in, e.source_move_id,
       e.source_tax_id
FROM generate_series(TIMESTAMP '2000-04-01', TIMESTAMP '2000-06-30', INTERVAL 1 DAY) AS c(d)
JOIN cost_events e ON e.date <= CAST(c.d AS DATE)
QUALIFY row_number() OVER (PARTITION BY e.product_id, c.d ORDER BY e.date DESC, {_NEWEST}) = 1
""",
    cost_unit_tax_in=4,
)
def _(t: Tables):
    return costs.cost_history(t.cost_events, HISTORY_START, AS_OF)


# Bills that arrive after the history was stored: every tenth one of three months.
LATE_START, LATE_END = date(2000, 4, 11), date(2000, 6, 11)


def _late():
    return (F.col("source_move_id") % 10 == 3) & F.col("date").between(
        F.lit(LATE_START), F.lit(LATE_END)
    )


def _late_ranges(t: Tables):
    known = t.cost_events.where(~_late())
    inside = F.col("date").between(F.lit(LATE_START), F.lit(LATE_END))
    changes = costs.changed_costs(known.where(inside), t.cost_events.where(inside))
    return costs.dirty_ranges(changes, t.cost_events.where(F.col("date") >= F.lit(LATE_START)), AS_OF)


@register(
    "late_bill_history",
    f"""
SELECT CAST(c.d AS DATE) AS date, e.product_id, e.cost_unit_tax_in, e.source_move_id,
       e.source_tax_id
FROM generate_series(TIMESTAMP '2000-04-01', TIMESTAMP '2000-06-30', INTERVAL 1 DAY) AS c(d)
JOIN cost_events e ON e.date <= CAST(c.d AS DATE)
QUALIFY row_number() OVER (PARTITION BY e.product_id, c.d ORDER BY e.date DESC, {_NEWEST}) = 1
""",
    cost_unit_tax_in=4,
)
def _(t: Tables):
    """The history stored without the late bills, patched where they change it: equal to one load."""
    stored = costs.cost_history(t.cost_events.where(~_late()), HISTORY_START, AS_OF)
    ranges = _late_ranges(t)
    # What is known: the stored snapshot of the day before the first change, and the events since.
    before = LATE_START - timedelta(days=1)
    snapshot = stored.where(F.col("date") == F.lit(before))
    since = t.cost_events.where(F.col("date").between(F.lit(LATE_START), F.lit(AS_OF)))
    fresh = costs.cost_history_in(snapshot.unionByName(since.select(*snapshot.columns)), ranges)
    return costs.patched(stored, fresh, costs.days_of(ranges))


@register(
    "late_bill_ranges",
    f"""
WITH ranked AS (
  SELECT *, source_move_id % 10 = 3 AND date BETWEEN DATE '2000-04-11' AND DATE '2000-06-11' AS late
  FROM cost_events WHERE date BETWEEN DATE '2000-04-11' AND DATE '2000-06-30'),
days AS (
  SELECT product_id, date, lead(date) OVER (PARTITION BY product_id ORDER BY date) AS next_day, late
  FROM (SELECT product_id, date, late FROM ranked
        QUALIFY row_number() OVER (PARTITION BY product_id, date ORDER BY {_NEWEST}) = 1)),
changed AS (
  SELECT product_id, date, CAST(coalesce(next_day - 1, DATE '2000-06-30') AS DATE) AS until
  FROM days WHERE late),
starts AS (
  SELECT *, CASE WHEN lag(until) OVER (PARTITION BY product_id ORDER BY date) = date - 1
                 THEN 0 ELSE 1 END AS opens
  FROM changed)
SELECT product_id, min(date) AS first_day, max(until) AS last_day
FROM (SELECT *, sum(opens) OVER (PARTITION BY product_id ORDER BY date) AS island FROM starts)
GROUP BY product_id, island
""",
)
def _(t: Tables):
    return _late_ranges(t)


@register(
    "cost_history_intervals",
    f"""
SELECT product_id, date AS valid_from,
       CAST(lead(date) OVER (PARTITION BY product_id ORDER BY date) - 1 AS DATE) AS valid_to,
       cost_unit_tax_in, source_move_id, source_tax_id
FROM (SELECT * FROM cost_events
      QUALIFY row_number() OVER (PARTITION BY product_id, date ORDER BY {_NEWEST}) = 1)
""",
    cost_unit_tax_in=4,
)
def _(t: Tables):
    return costs.cost_intervals(t.cost_events)


@register(
    "unified_cost",
    f"""
SELECT product_id, cost_unit_tax_in, source_tax_id, cost_source, effective_date FROM (
  SELECT product_id, 1 AS priority, date AS effective_date, source_move_id, cost_unit_tax_in,
         source_tax_id, 'latest_purchase' AS cost_source
  FROM ({_snapshot_sql("1996-06-30")})
  UNION ALL
  SELECT product_id, priority, effective_date, 0, cost_unit_tax_in, source_tax_id, cost_source
  FROM legacy_costs WHERE is_active AND cost_unit_tax_in > 0
    AND effective_date <= DATE '1996-06-30')
QUALIFY row_number() OVER (PARTITION BY product_id
  ORDER BY priority, effective_date DESC, source_move_id DESC, cost_unit_tax_in DESC) = 1
""",
    cost_unit_tax_in=4,
)
def _(t: Tables):
    bought = costs.cost_snapshot(t.cost_events, EARLY_AS_OF)
    return costs.unified_cost(bought, t.legacy_costs, EARLY_AS_OF)


@register("unified_cost_by_day", "SELECT * FROM product_day_costs", cost_unit_tax_in=4)
def _(t: Tables):
    return costs.unified_cost_by_day(t.cost_events, t.legacy_costs, t.taxed_lines)


_AS_OF_COST = f"""
SELECT d.date, d.product_id, e.cost_unit_tax_in, e.source_move_id, e.source_tax_id
FROM (SELECT DISTINCT product_id, date FROM taxed_lines) d
JOIN cost_events e ON e.product_id = d.product_id AND e.date <= d.date
QUALIFY row_number() OVER (PARTITION BY d.product_id, d.date
  ORDER BY e.date DESC, {_NEWEST.replace("source_", "e.source_").replace(" cost", " e.cost")}) = 1
"""


@register("cost_as_of_sale_day", _AS_OF_COST, cost_unit_tax_in=4)
def _(t: Tables):
    return costs.cost_as_of(t.cost_events, t.taxed_lines)


@register(
    "inventory_cost",
    f"""
WITH bought AS (SELECT product_id, cost_unit_tax_in FROM ({_snapshot_sql("1996-06-30")})
                WHERE cost_unit_tax_in > 0)
SELECT * FROM bought
UNION ALL
SELECT product_id, cost_unit_tax_in FROM beginning_costs
WHERE is_active AND cost_unit_tax_in > 0 AND effective_date <= DATE '1996-06-30'
  AND product_id NOT IN (SELECT product_id FROM bought)
""",
    cost_unit_tax_in=4,
)
def _(t: Tables):
    return costs.inventory_cost(
        costs.latest_cost_by_day(t.cost_events), t.beginning_costs, EARLY_AS_OF
    )
