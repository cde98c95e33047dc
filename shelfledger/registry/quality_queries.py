"""Data checks, coverage and refresh decisions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from shelfledger.operators import quality, refresh
from shelfledger.operators.profit import profit_daily
from shelfledger.registry.core import register
from shelfledger.registry.tables import AS_OF, FIRST_DAY, HALF_START, LAST_DAY, Tables


@register(
    "validate_table",
    """
SELECT 'schema' AS rule, name AS subject, CAST(CASE WHEN name = 'weight' THEN 1 ELSE 0 END AS BIGINT)
         AS violations, name <> 'weight' AS passed
FROM (VALUES ('order_id'), ('revenue'), ('weight'), ('order_ref'), ('date')) AS v(name)
UNION ALL
SELECT 'no_nulls', 'order_id', count(*) FILTER (WHERE order_id IS NULL),
       count(*) FILTER (WHERE order_id IS NULL) = 0 FROM fact_sales
UNION ALL
SELECT 'no_nulls', 'order_ref', count(*) FILTER (WHERE order_ref IS NULL),
       count(*) FILTER (WHERE order_ref IS NULL) = 0 FROM fact_sales
UNION ALL
SELECT 'min_rows', '1', CAST(greatest(1 - count(*), 0) AS BIGINT), count(*) >= 1 FROM fact_sales
UNION ALL
SELECT 'date_range', 'date',
       count(*) FILTER (WHERE CAST(date AS DATE) < DATE '1995-01-01'
                           OR CAST(date AS DATE) > DATE '2000-06-30'),
       count(*) FILTER (WHERE CAST(date AS DATE) < DATE '1995-01-01'
                           OR CAST(date AS DATE) > DATE '2000-06-30') = 0 FROM fact_sales
""",
)
def _(t: Tables):
    return quality.validate(
        t.fact_sales,
        expected=["order_id", "revenue", "weight"],
        not_null=["order_id", "order_ref"],
        min_rows=1,
        date_column="date",
        min_date=FIRST_DAY,
        max_date=AS_OF,
    )


@register(
    "profit_line_checks",
    """
SELECT *, CASE WHEN profit_mismatch + cogs_mismatch + null_profit + negative_cogs = 0
               THEN 'VALID' ELSE 'INVALID' END AS status
FROM (
  SELECT date, count(*) AS lines,
         count(*) FILTER (WHERE abs(gross_profit - (revenue_tax_in - cogs_tax_in)) > 0.01)
           AS profit_mismatch,
         count(*) FILTER (WHERE abs(cogs_tax_in - cost_unit_tax_in * quantity) > 0.01)
           AS cogs_mismatch,
         count(*) FILTER (WHERE gross_profit IS NULL) AS null_profit,
         count(*) FILTER (WHERE cogs_tax_in < 0) AS negative_cogs
  FROM profit_lines GROUP BY date)
""",
)
def _(t: Tables):
    return quality.profit_line_checks(t.profit_lines)


@register(
    "cost_event_checks",
    """
SELECT count(*) AS events, count(*) FILTER (WHERE NOT cost_unit_tax_in > 0) AS non_positive_cost,
       count(*) FILTER (WHERE product_id = 0) AS no_product
FROM cost_events
""",
)
def _(t: Tables):
    return quality.cost_event_checks(t.cost_events)


# Every fifth day of a month carries a wrong revenue, every seventh a wrong count.
@register(
    "daily_total_checks",
    "SELECT date, day(date) % 5 = 0 OR day(date) % 7 = 0 AS mismatch FROM agg_profit_daily",
)
def _(t: Tables):
    daily = profit_daily(t.profit_lines)
    day = F.dayofmonth("date")
    daily = daily.withColumns(
        {
            "revenue_tax_in": F.col("revenue_tax_in") + F.when(day % 5 == 0, 1.0).otherwise(0.0),
            "lines": F.col("lines") - F.when(day % 7 == 0, 1).otherwise(0),
        }
    )
    return quality.daily_total_checks(t.profit_lines, daily)


_DAYS = """
SELECT CAST(d AS DATE) AS date
FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-01', INTERVAL 1 DAY) AS g(d)
"""


@register(
    "partition_coverage",
    f"""
WITH found AS (
  SELECT CAST(date AS DATE) AS date, 'fact_sales' AS "table", count(*) AS rows
  FROM fact_sales GROUP BY 1
  UNION ALL
  SELECT date, 'fact_purchases', count(*) FROM fact_purchases GROUP BY 1),
expected AS (
  SELECT date, "table" FROM ({_DAYS}), (VALUES ('fact_sales'), ('fact_purchases')) AS v("table"))
SELECT e.date, e."table", CASE WHEN f.rows IS NULL THEN 'Missing' ELSE 'OK' END AS status,
       coalesce(f.rows, 0) AS rows
FROM expected e LEFT JOIN found f ON f.date = e.date AND f."table" = e."table"
""",
)
def _(t: Tables):
    return quality.coverage(
        {"fact_sales": t.fact_sales, "fact_purchases": t.fact_purchases}, FIRST_DAY, LAST_DAY
    )


@register(
    "layer_status_by_day",
    f"""
WITH raw AS (SELECT date, count(*) AS n FROM fact_purchases GROUP BY 1),
clean AS (SELECT date, count(*) AS n FROM fact_purchases WHERE day(date) <> 7 GROUP BY 1),
fact AS (SELECT date, CAST(count_if(quantity > 3) AS BIGINT) AS n FROM fact_purchases WHERE day(date) <> 9 GROUP BY 1)
SELECT d.date,
  CASE WHEN raw.n IS NULL THEN 'Missing' WHEN raw.n = 0 THEN 'Empty' ELSE 'OK' END AS raw_status,
  coalesce(raw.n, 0) AS raw_rows,
  CASE WHEN clean.n IS NULL THEN 'Missing' WHEN clean.n = 0 THEN 'Empty' ELSE 'OK' END AS clean_status,
  coalesce(clean.n, 0) AS clean_rows,
  CASE WHEN fact.n IS NULL THEN 'Missing' WHEN fact.n = 0 THEN 'Empty' ELSE 'OK' END AS fact_status,
  coalesce(fact.n, 0) AS fact_rows
FROM ({_DAYS}) d LEFT JOIN raw ON raw.date = d.date LEFT JOIN clean ON clean.date = d.date
LEFT JOIN fact ON fact.date = d.date
""",
)
def _(t: Tables):
    bills, day = t.fact_purchases, F.dayofmonth("date")
    layers = {
        "raw": quality.day_counts(bills),
        "clean": quality.day_counts(bills.where(day != 7)),
        "fact": bills.where(day != 9)
        .groupBy("date")
        .agg(F.count_if(F.col("quantity") > 3).alias("rows")),
    }
    return quality.layer_status(layers, FIRST_DAY, LAST_DAY)


@register(
    "dimension_status",
    """
SELECT "table", CASE WHEN rows = 0 THEN 'Empty' ELSE 'OK' END AS status, rows FROM (
  SELECT 'dim_products' AS "table", count(*) AS rows FROM dim_products
  UNION ALL SELECT 'dim_partners', count(*) FROM customer
  UNION ALL SELECT 'dim_users', count(*) FROM supplier
  UNION ALL SELECT 'dim_companies', count(*) FROM nation)
""",
)
def _(t: Tables):
    return quality.table_status(
        {
            "dim_products": t.dim_products,
            "dim_partners": t.given("customer"),
            "dim_users": t.given("supplier"),
            "dim_companies": t.given("nation"),
        }
    )


@register(
    "missing_date_ranges",
    f"""
SELECT min(date) AS start_date, max(date) AS end_date, count(*) AS days FROM (
  SELECT date, date - CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS island
  FROM ({_DAYS})
  WHERE date NOT IN (SELECT CAST(date AS DATE) FROM fact_purchases WHERE date IS NOT NULL))
GROUP BY island
""",
)
def _(t: Tables):
    return quality.missing_ranges(t.fact_purchases, FIRST_DAY, LAST_DAY)


_SYNC = """
SELECT coalesce(s.date, d.date) AS date, s.date IS NOT NULL AS src, d.date IS NOT NULL AS drv
FROM (SELECT DISTINCT date FROM fact_invoice_sales
      WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-08-01') s
FULL OUTER JOIN (SELECT DISTINCT date FROM fact_purchases
      WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-08-01') d ON d.date = s.date
"""


@register(
    "sync_differences",
    f"""
SELECT date, CASE WHEN src THEN 'missing' ELSE 'orphaned' END AS difference
FROM ({_SYNC}) WHERE src <> drv
""",
)
def _(t: Tables):
    return quality.sync_differences(t.fact_invoice_sales, t.fact_purchases, FIRST_DAY, LAST_DAY)


@register(
    "sync_status",
    f"""
SELECT *, CASE WHEN missing_days = 0 AND orphaned_days = 0 THEN 'SYNCED'
               WHEN orphaned_days = 0 THEN 'STALE' WHEN missing_days = 0 THEN 'ORPHANED'
               ELSE 'MIXED' END AS status
FROM (SELECT count(*) FILTER (WHERE src) AS source_days, count(*) FILTER (WHERE drv)
               AS derived_days,
             count(*) FILTER (WHERE src AND NOT drv) AS missing_days,
             count(*) FILTER (WHERE drv AND NOT src) AS orphaned_days FROM ({_SYNC}))
""",
)
def _(t: Tables):
    return quality.sync_status(t.fact_invoice_sales, t.fact_purchases, FIRST_DAY, LAST_DAY)


@register(
    "days_behind",
    """
SELECT max(date) AS last_date,
       CAST(DATE '2001-08-15' - max(date) AS INTEGER) AS days_behind,
       CASE WHEN DATE '2001-08-15' - max(date) <= 1 THEN 'healthy' ELSE 'unhealthy' END AS status
FROM fact_invoice_sales
""",
)
def _(t: Tables):
    return quality.days_behind(t.fact_invoice_sales, date(2001, 8, 15))


@register(
    "refresh_incremental_sales_daily",
    """
SELECT * FROM agg_sales_daily WHERE date > DATE '1998-04-17'
""",
    revenue=4,
)
def _(t: Tables):
    known = t.agg_sales_daily.where(F.col("date") <= F.lit(HALF_START))
    return refresh.newer_than(t.agg_sales_daily, known)


@register("refresh_full_sales_daily", "SELECT * FROM agg_sales_daily", revenue=4)
def _(t: Tables):
    nothing = t.agg_sales_daily.where(F.lit(False))
    return refresh.newer_than(t.agg_sales_daily, nothing)


@register(
    "catch_up_days",
    f"""
SELECT date FROM ({_DAYS})
WHERE date NOT IN (SELECT date FROM agg_sales_daily)
  AND date IN (SELECT CAST(date AS DATE) FROM fact_sales UNION SELECT date FROM fact_invoice_sales)
""",
)
def _(t: Tables):
    source = t.fact_sales.select(F.col("date").cast("date").alias("date")).unionByName(
        t.fact_invoice_sales.select("date")
    )
    return refresh.days_to_load(source, t.agg_sales_daily, FIRST_DAY, LAST_DAY)
