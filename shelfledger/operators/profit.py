"""Line profit, profit aggregates and profit reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from shelfledger import constants as K
from shelfledger.functions.columns import (
    day_range,
    not_cancelled,
    product_label,
    ratio,
    tax_multiplier,
    zero_if_null,
)
from shelfledger.functions.calendar import unit_of
from shelfledger.functions.skew import splittable
from shelfledger.operators.costs import cost_as_of, unified_cost_by_day
from shelfledger.operators.sales import bucketed, change_pct, ranked_money, window_sums

MEASURES = ("revenue_tax_in", "cogs_tax_in", "gross_profit", "quantity")


def taxed_sales(pos: DataFrame, invoices: DataFrame) -> DataFrame:
    """POS and invoice lines with tax-inclusive revenue, cancelled documents left out."""
    shop = pos.where(not_cancelled(F.col("order_ref"))).select(
        F.lit("pos").alias("channel"),
        F.col("date").cast("date").alias("date"),
        F.nvl("order_id", F.lit(0)).alias("txn_id"),
        F.nvl("line_id", F.lit(0)).alias("line_id"),
        F.nvl("product_id", F.lit(0)).alias("product_id"),
        zero_if_null(F.col("quantity")).alias("quantity"),
        zero_if_null(F.col("revenue")).alias("revenue_tax_in"),
    )
    billed = invoices.where(not_cancelled(F.col("move_name"))).select(
        F.lit("invoice").alias("channel"),
        F.col("date").cast("date").alias("date"),
        F.nvl("move_id", F.lit(0)).alias("txn_id"),
        F.nvl("move_line_id", F.lit(0)).alias("line_id"),
        F.nvl("product_id", F.lit(0)).alias("product_id"),
        zero_if_null(F.col("quantity")).alias("quantity"),
        (
            zero_if_null(F.col("price_unit"))
            * zero_if_null(F.col("quantity"))
            * tax_multiplier(F.col("tax_id"))
        ).alias("revenue_tax_in"),
    )
    return shop.unionByName(billed)


def _priced(lines: DataFrame, zero_missing_cost: bool) -> DataFrame:
    """Cost of goods and gross profit.  An unknown cost gives NULL, not a free sale."""
    known = F.col("cost_unit_tax_in")
    used = zero_if_null(known) if zero_missing_cost else known
    cogs = used * F.col("quantity")
    return lines.select(
        "channel",
        "date",
        "txn_id",
        "line_id",
        "product_id",
        "quantity",
        "revenue_tax_in",
        zero_if_null(known).alias("cost_unit_tax_in"),
        cogs.alias("cogs_tax_in"),
        (F.col("revenue_tax_in") - cogs).alias("gross_profit"),
        F.lit(None).cast("bigint").alias("source_cost_move_id"),
        F.nvl("source_tax_id", F.lit(0)).alias("source_cost_tax_id"),
        known.isNull().alias("cost_missing"),
    )


def line_profit(sales: DataFrame, costs: DataFrame, zero_missing_cost: bool = False) -> DataFrame:
    """Profit per line from one cost per product (lines of one day, or one cost date)."""
    costs = splittable(costs.select("product_id", "cost_unit_tax_in", "source_tax_id"))
    return _priced(sales.join(costs, "product_id", "left"), zero_missing_cost)


def _at_day_cost(sales: DataFrame, day_costs: DataFrame, zero_missing_cost: bool) -> DataFrame:
    """Join on (product, day).

    The cost side has a row for every product day with a sale, which grows with
    the sales and is far larger than file sizes suggest, so it is never broadcast.
    """
    day_costs = day_costs.select("product_id", "date", "cost_unit_tax_in", "source_tax_id")
    return _priced(
        sales.join(day_costs.hint("merge"), ["product_id", "date"], "left"), zero_missing_cost
    )


def line_profit_by_day(
    sales: DataFrame, events: DataFrame, legacy: DataFrame, zero_missing_cost: bool = False
) -> DataFrame:
    """Profit per line for any number of days, each line at the cost known on its day.

    Lines meet their cost on (product, day), so even a product with a third of
    all lines is spread over its days.
    """
    return _at_day_cost(sales, unified_cost_by_day(events, legacy, sales), zero_missing_cost)


def line_profit_in_intervals(
    sales: DataFrame,
    intervals: DataFrame,
    first_day: date,
    last_day: date,
    zero_missing_cost: bool = False,
) -> DataFrame:
    """Profit per line, each line at the cost whose interval holds its day; sales are read once.

    Intervals are cut to [first_day, last_day], the bounds of the sales, and split at the ends of months.  Lines
    meet them on (product, month), so the interval join is an equality join with one more condition: a product with
    a third of all lines is spread over its months, and each side is shuffled once.  A line outside the
    bounds has no known cost.
    """
    inside = intervals.select(
        F.col("product_id"),
        F.greatest("valid_from", F.lit(first_day)).alias("_from"),
        F.least(F.nvl("valid_to", F.lit(last_day)), F.lit(last_day)).alias("_to"),
        "cost_unit_tax_in",
        "source_tax_id",
    ).where(F.col("_from") <= F.col("_to"))
    months = F.sequence(F.trunc("_from", "month"), F.trunc("_to", "month"), F.expr("interval 1 month"))
    pieces = inside.withColumn("_month", F.explode(months))
    lines = sales.withColumn("_month", F.trunc("date", "month"))
    holds = (
        (lines["product_id"] == pieces["product_id"])
        & (lines["_month"] == pieces["_month"])
        & lines["date"].between(pieces["_from"], pieces["_to"])
    )
    joined = lines.join(splittable(pieces), holds, "left").drop(pieces["product_id"])
    return _priced(joined, zero_missing_cost)


def line_profit_as_of(
    sales: DataFrame, events: DataFrame, zero_missing_cost: bool = False
) -> DataFrame:
    """Profit per line at the most recent purchase cost on the sale date."""
    return _at_day_cost(sales, cost_as_of(events, sales), zero_missing_cost)


# --- aggregates --------------------------------------------------------------------------


def profit_daily(lines: DataFrame) -> DataFrame:
    """Sums, distinct transactions, lines, and lines without a known cost, per day."""
    return lines.groupBy("date").agg(
        *[F.sum(name).alias(name) for name in MEASURES],
        F.countDistinct("channel", "txn_id").alias("transactions"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if("cost_missing").cast("bigint").alias("cost_missing"),
    )


def profit_daily_by_product(lines: DataFrame) -> DataFrame:
    return lines.groupBy("date", "product_id").agg(
        *[F.sum(name).alias(name) for name in MEASURES],
        F.count(F.lit(1)).alias("lines"),
    )


# --- reports -------------------------------------------------------------------------------


def _margin(profit: Column, revenue: Column) -> Column:
    return ratio(profit, revenue, 100.0)


def profit_summary(daily: DataFrame, start: date, end: date) -> DataFrame:
    """One row of totals; 0 where there is nothing to sum."""
    sums = daily.where(day_range(F.col("date"), start, end)).agg(
        zero_if_null(F.sum("revenue_tax_in")).alias("revenue"),
        zero_if_null(F.sum("cogs_tax_in")).alias("cogs"),
        zero_if_null(F.sum("gross_profit")).alias("gross_profit"),
        zero_if_null(F.sum("quantity")).alias("quantity"),
        F.nvl(F.sum("transactions"), F.lit(0)).alias("transactions"),
        F.nvl(F.sum("lines"), F.lit(0)).alias("lines"),
    )
    return sums.select(
        "*",
        ratio(F.col("revenue"), F.col("transactions")).alias("avg_transaction_value"),
        _margin(F.col("gross_profit"), F.col("revenue")).alias("gross_margin_pct"),
    )


def profit_trend(daily: DataFrame, start: date, end: date, period: str = "daily") -> DataFrame:
    """Profit per bucket, labelled with the day after the bucket."""
    unit = unit_of(period)
    buckets = bucketed(
        daily,
        start,
        end,
        period,
        {
            "revenue": "revenue_tax_in",
            "cogs": "cogs_tax_in",
            "gross_profit": "gross_profit",
            "items_sold": "quantity",
            "transactions": "transactions",
            "lines": "lines",
        },
    )
    bucket_end = {
        "day": F.date_add("date", 1),
        "week": F.date_add("date", 7),
        "month": F.add_months("date", 1),
    }[unit]
    return buckets.select(
        bucket_end.alias("date"),
        *[
            zero_if_null(F.col(name)).alias(name)
            for name in ("revenue", "cogs", "gross_profit", "items_sold")
        ],
        F.nvl("transactions", F.lit(0)).alias("transactions"),
        F.nvl("lines", F.lit(0)).alias("lines"),
        ratio(F.col("revenue"), F.col("transactions")).alias("avg_transaction_value"),
        zero_if_null(_margin(F.col("gross_profit"), F.col("revenue"))).alias("gross_margin_pct"),
    ).orderBy("date")


def profit_by_product(
    by_product: DataFrame, products: DataFrame, start: date, end: date, limit: int = 20
) -> DataFrame:
    """Best products by gross profit; products without any known cost come last."""
    best = (
        by_product.where(day_range(F.col("date"), start, end))
        .groupBy("product_id")
        .agg(
            F.sum("revenue_tax_in").alias("total_revenue"),
            F.sum("cogs_tax_in").alias("total_cogs"),
            F.sum("gross_profit").alias("total_profit"),
            F.sum("quantity").alias("total_quantity"),
            F.sum("lines").alias("total_lines"),
        )
        .orderBy(ranked_money("total_profit").desc_nulls_last(), "product_id")
        .limit(limit)
    )
    names = products.select("product_id", "product_name", "product_category")
    return (
        best.join(names, "product_id", "left")
        .select(
            "product_id",
            product_label(F.col("product_name"), F.col("product_id")).alias("product_name"),
            F.nvl("product_category", F.lit(K.UNKNOWN_CATEGORY)).alias("category"),
            "total_revenue",
            "total_cogs",
            "total_profit",
            "total_quantity",
            "total_lines",
            _margin(F.col("total_profit"), F.col("total_revenue")).alias("profit_margin_pct"),
        )
        .orderBy(ranked_money("total_profit").desc_nulls_last(), "product_id")
    )


def profit_drilldown(
    lines: DataFrame, start: date, end: date, product_id: int | None = None
) -> DataFrame:
    """Line rows with margin, by date and falling profit."""
    rows = lines.where(day_range(F.col("date"), start, end))
    if product_id is not None:
        rows = rows.where(F.col("product_id") == product_id)
    return rows.select(
        "date",
        "txn_id",
        "line_id",
        "product_id",
        "quantity",
        "revenue_tax_in",
        "cost_unit_tax_in",
        "cogs_tax_in",
        "gross_profit",
        _margin(F.col("gross_profit"), F.col("revenue_tax_in")).alias("profit_margin_pct"),
    ).orderBy("date", F.col("gross_profit").desc())


def profit_revenue_by_category(
    by_product: DataFrame, products: DataFrame, start: date, end: date
) -> DataFrame:
    """Taxed revenue per parent category and category, products summed first."""
    totals = (
        by_product.where(day_range(F.col("date"), start, end))
        .groupBy("product_id")
        .agg(F.sum("revenue_tax_in").alias("revenue"))
    )
    labels = products.select("product_id", "product_parent_category", "product_category")
    return (
        totals.join(labels, "product_id", "left")
        .groupBy(
            F.nvl("product_parent_category", F.lit(K.UNKNOWN)).alias("parent_category"),
            F.nvl("product_category", F.lit(K.UNKNOWN)).alias("category"),
        )
        .agg(F.sum("revenue").alias("revenue"))
        .orderBy(ranked_money("revenue").desc(), "parent_category", "category")
    )


def executive_kpis(daily: DataFrame, start: date, end: date) -> DataFrame:
    """Current window against the one before: revenue change, cost share, margin change."""
    sums = window_sums(
        daily,
        start,
        end,
        {
            "revenue": "revenue_tax_in",
            "cogs": "cogs_tax_in",
            "gross_profit": "gross_profit",
            "transactions": "transactions",
        },
    ).withColumns(
        {
            f"{side}_margin_pct": _margin(F.col(f"{side}_gross_profit"), F.col(f"{side}_revenue"))
            for side in ("cur", "prev")
        }
    )
    current, previous = F.col("cur_margin_pct"), F.col("prev_margin_pct")
    return sums.select(
        "*",
        ratio(F.col("cur_revenue"), F.col("cur_transactions")).alias("cur_avg_transaction_value"),
        (F.col("cur_revenue") - F.col("prev_revenue")).alias("revenue_delta"),
        F.when(
            F.col("prev_revenue") != 0, change_pct(F.col("cur_revenue"), F.col("prev_revenue"))
        ).alias("revenue_delta_pct"),
        ratio(F.col("cur_cogs"), F.col("cur_revenue"), 100.0).alias("cogs_pct"),
        (current - previous).alias("margin_change"),
        change_pct(current, previous).alias("margin_change_pct"),
    )
