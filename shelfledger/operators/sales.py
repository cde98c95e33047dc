"""Combined sales lines, sales aggregates and sales reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfledger import constants as K
from shelfledger.functions.calendar import (
    calendar,
    floor_to,
    next_bucket,
    ordered,
    previous_window,
    unit_of,
)
from shelfledger.functions.columns import day_range, not_cancelled, product_label, ratio, zero_if_null
from shelfledger.session import cut_lineage

MONEY_DIGITS = 4


def ranked_money(name: str) -> Column:
    """Sort key for money: rounded, so the order of summation cannot change a rank."""
    return F.round(F.col(name), MONEY_DIGITS)


# --- lines ---------------------------------------------------------------------------


def combined_sales(pos: DataFrame, invoices: DataFrame) -> DataFrame:
    """POS and invoice lines without cancelled documents; invoice revenue is untaxed.

    ``sold_at`` is the local time, ``date`` its day.  ``channel`` keeps order ids
    and invoice ids apart.
    """
    shop = pos.where(not_cancelled(F.col("order_ref"))).select(
        F.lit("pos").alias("channel"),
        F.col("date").alias("sold_at"),
        F.col("date").cast("date").alias("date"),
        F.nvl("order_id", F.lit(0)).alias("txn_id"),
        F.nvl("line_id", F.lit(0)).alias("line_id"),
        F.nvl("product_id", F.lit(0)).alias("product_id"),
        zero_if_null(F.col("revenue")).alias("revenue"),
        zero_if_null(F.col("quantity")).alias("quantity"),
        F.col("order_ref"),
    )
    billed = invoices.where(not_cancelled(F.col("move_name"))).select(
        F.lit("invoice").alias("channel"),
        F.col("date").cast("timestamp_ntz").alias("sold_at"),
        F.col("date").cast("date").alias("date"),
        F.nvl("move_id", F.lit(0)).alias("txn_id"),
        F.nvl("move_line_id", F.lit(0)).alias("line_id"),
        F.nvl("product_id", F.lit(0)).alias("product_id"),
        (zero_if_null(F.col("price_unit")) * zero_if_null(F.col("quantity"))).alias("revenue"),
        zero_if_null(F.col("quantity")).alias("quantity"),
        F.col("move_name").alias("order_ref"),
    )
    return shop.unionByName(billed)


# --- aggregates ------------------------------------------------------------------------


def sales_daily(lines: DataFrame) -> DataFrame:
    """Revenue, distinct transactions, items and lines per day."""
    return lines.groupBy("date").agg(
        F.sum("revenue").alias("revenue"),
        F.countDistinct("channel", "txn_id").alias("transactions"),
        F.sum("quantity").alias("items_sold"),
        F.count(F.lit(1)).alias("lines"),
    )


def sales_daily_by_product(lines: DataFrame) -> DataFrame:
    return lines.groupBy("date", "product_id").agg(
        F.sum("revenue").alias("revenue"),
        F.sum("quantity").alias("quantity"),
        F.count(F.lit(1)).alias("lines"),
    )


def principal_name(brand: Column) -> Column:
    return F.when(brand.isNull() | (F.trim(brand) == ""), F.lit(K.UNKNOWN)).otherwise(brand)


def sales_daily_by_principal(by_product: DataFrame, products: DataFrame) -> DataFrame:
    """Rolls the day x product aggregate up to brands; sales lines are not read again."""
    brands = products.groupBy("product_id").agg(F.max("product_brand").alias("product_brand"))
    return (
        by_product.join(brands, "product_id", "left")
        .groupBy("date", principal_name(F.col("product_brand")).alias("principal"))
        .agg(
            F.sum("revenue").alias("revenue"),
            F.sum("quantity").alias("quantity"),
            F.sum("lines").alias("lines"),
        )
    )


# --- reports on the aggregates -----------------------------------------------------------


def sales_by_principal(
    by_principal: DataFrame, start: date, end: date, limit: int = 20
) -> DataFrame:
    return (
        by_principal.where(day_range(F.col("date"), start, end))
        .groupBy("principal")
        .agg(F.sum("revenue").alias("revenue"))
        .orderBy(ranked_money("revenue").desc(), "principal")
        .limit(limit)
    )


def named_principals(principals: DataFrame, limit: int = 20) -> DataFrame:
    """Only principals with a usable name, best first."""
    name = F.col("principal")
    return (
        principals.where(
            name.isNotNull() & ~name.isin(*K.NO_PRINCIPAL_NAMES) & (F.length(F.trim(name)) > 1)
        )
        .orderBy(ranked_money("revenue").desc(), "principal")
        .limit(limit)
    )


def bucketed(
    daily: DataFrame, start: date, end: date, period: str, totals: dict[str, str]
) -> DataFrame:
    """Sums per calendar bucket, buckets without data included as NULL sums.

    The day rows are reduced to buckets first and joined to the calendar on
    equality, so no range join is needed.  First and last bucket are whole.  The
    sums are broadcast: they hold at most one row per bucket of the calendar.
    """
    unit = unit_of(period)
    start, end = ordered(start, end)
    first, after = floor_to(start, unit), next_bucket(floor_to(end, unit), unit)
    day = F.col("date")
    sums = (
        daily.where((day >= F.lit(first)) & (day < F.lit(after)))
        .groupBy((day if unit == "day" else F.trunc(day, unit)).alias("date"))
        .agg(*[F.sum(source).alias(name) for name, source in totals.items()])
    )
    return calendar(daily.sparkSession, start, end, unit).join(F.broadcast(sums), "date", "left")


def sales_trend(daily: DataFrame, start: date, end: date, period: str = "daily") -> DataFrame:
    """Revenue, transactions, items and average transaction value per bucket start."""
    buckets = bucketed(
        daily,
        start,
        end,
        period,
        {"revenue": "revenue", "transactions": "transactions", "items_sold": "items_sold"},
    )
    return buckets.select(
        "date",
        zero_if_null(F.col("revenue")).alias("revenue"),
        F.nvl("transactions", F.lit(0)).alias("transactions"),
        zero_if_null(F.col("items_sold")).alias("items_sold"),
        ratio(F.col("revenue"), F.col("transactions")).alias("avg_transaction_value"),
    ).orderBy("date")


def daily_transactions(daily: DataFrame, start: date, end: date) -> DataFrame:
    return sales_trend(daily, start, end).select("date", "transactions")


def _opening_hours(lines: DataFrame, start: date, end: date) -> DataFrame:
    hour = F.hour("sold_at")
    return lines.where(
        day_range(F.col("sold_at"), start, end) & hour.between(K.FIRST_HOUR, K.LAST_HOUR)
    ).withColumn("hour", hour)


def hourly_pattern(lines: DataFrame, day: date, until: date | None = None) -> DataFrame:
    """Revenue and distinct transactions per opening hour of ``day`` (or of a range)."""
    spark = lines.sparkSession
    hours = spark.range(K.FIRST_HOUR, K.LAST_HOUR + 1, 1, numPartitions=1).select(
        F.col("id").cast("int").alias("hour")
    )
    sums = (
        _opening_hours(lines, day, until or day)
        .groupBy("hour")
        .agg(
            F.sum("revenue").alias("revenue"),
            F.countDistinct("channel", "txn_id").alias("transactions"),
        )
    )
    return (
        hours.join(F.broadcast(sums), "hour", "left")  # at most one row per opening hour
        .select(
            "hour",
            zero_if_null(F.col("revenue")).alias("revenue"),
            F.nvl("transactions", F.lit(0)).alias("transactions"),
        )
        .orderBy("hour")
    )


def hourly_heatmap(lines: DataFrame, start: date, end: date) -> DataFrame:
    return (
        _opening_hours(lines, start, end)
        .groupBy("date", "hour")
        .agg(F.sum("revenue").alias("revenue"))
        .orderBy("date", "hour")
    )


def heatmap_pivot(heatmap: DataFrame) -> DataFrame:
    """Day rows x hour columns; the hours are given, so no pass looks for them."""
    hours = list(range(K.FIRST_HOUR, K.LAST_HOUR + 1))
    wide = heatmap.groupBy("date").pivot("hour", hours).agg(F.sum("revenue"))
    return wide.select(
        "date", *[zero_if_null(F.col(f"`{hour}`")).alias(f"h{hour:02d}") for hour in hours]
    ).orderBy("date")


def product_sales(by_product: DataFrame, start: date, end: date) -> DataFrame:
    """Units and revenue per product in the range."""
    return (
        by_product.where(day_range(F.col("date"), start, end))
        .groupBy("product_id")
        .agg(F.sum("quantity").alias("units_sold"), F.sum("revenue").alias("revenue"))
    )


def top_products(
    by_product: DataFrame, products: DataFrame, start: date, end: date, limit: int = 20
) -> DataFrame:
    """Best products by revenue; names are looked up for the winners only."""
    best = (
        product_sales(by_product, start, end)
        .orderBy(ranked_money("revenue").desc(), "product_id")
        .limit(limit)
    )
    names = products.select("product_id", "product_name", "product_category")
    return (
        best.join(names, "product_id", "left")
        .select(
            "product_id",
            product_label(F.col("product_name"), F.col("product_id")).alias("product_name"),
            F.nvl("product_category", F.lit(K.UNKNOWN_CATEGORY)).alias("category"),
            F.col("units_sold").alias("quantity_sold"),
            F.col("revenue").alias("total_unit_price"),
        )
        .orderBy(ranked_money("total_unit_price").desc(), "product_id")
    )


def window_sums(daily: DataFrame, start: date, end: date, measures: dict[str, str]) -> DataFrame:
    """``cur_*`` and ``prev_*`` sums of a window and the equal one before it, in one scan."""
    before = previous_window(start, end)
    day = F.col("date")
    inside = {"cur": day_range(day, start, end), "prev": day_range(day, *before)}
    return daily.where(day_range(day, before[0], end)).agg(
        *[
            F.nvl(F.sum(F.when(condition, F.col(source))), F.lit(0)).alias(f"{side}_{name}")
            for side, condition in inside.items()
            for name, source in measures.items()
        ]
    )


def change_pct(current: Column, previous: Column) -> Column:
    return F.when(previous != 0, (current - previous) / previous * F.lit(100.0)).otherwise(
        F.lit(0.0)
    )


def revenue_comparison(daily: DataFrame, start: date, end: date) -> DataFrame:
    """One row: current and previous window, deltas and percentage changes."""
    sums = window_sums(
        daily,
        start,
        end,
        {"revenue": "revenue", "transactions": "transactions", "items_sold": "items_sold"},
    )

    def average(side: str) -> Column:
        count = F.col(f"{side}_transactions")
        return F.when(count != 0, F.col(f"{side}_revenue") / count).otherwise(F.lit(0.0))

    atv = "avg_transaction_value"
    sums = sums.withColumns({f"{side}_{atv}": average(side) for side in ("cur", "prev")})
    names = ("revenue", "transactions", "items_sold", atv)
    return sums.select(
        *[F.col(f"{side}_{name}") for side in ("cur", "prev") for name in names],
        *[(F.col(f"cur_{name}") - F.col(f"prev_{name}")).alias(f"{name}_delta") for name in names],
        *[
            change_pct(F.col(f"cur_{name}"), F.col(f"prev_{name}")).alias(f"{name}_pct")
            for name in names
        ],
    )


# --- category reports ---------------------------------------------------------------------


def _categorised(totals: DataFrame, products: DataFrame) -> DataFrame:
    """Product totals with parent category, category and brand."""
    labels = products.select(
        "product_id", "product_parent_category", "product_category", "product_brand"
    )
    return totals.join(labels, "product_id", "left").withColumns(
        {
            "parent_category": F.nvl("product_parent_category", F.lit(K.UNKNOWN)),
            "category": F.nvl("product_category", F.lit(K.UNKNOWN)),
            "brand": F.nvl("product_brand", F.lit(K.UNKNOWN)),
        }
    )


def overview_summary(
    by_product: DataFrame, products: DataFrame, start: date, end: date
) -> DataFrame:
    """Grand total, parent x category and parent x category x brand in one grouping."""
    base = _categorised(product_sales(by_product, start, end), products)
    level = F.grouping_id()
    return base.groupingSets(
        [[], ["parent_category", "category"], ["parent_category", "category", "brand"]],
        "parent_category",
        "category",
        "brand",
    ).agg(
        F.when(level == 0, F.lit("brand"))
        .when(level == 1, F.lit("cat"))
        .otherwise(F.lit("summary"))
        .alias("type"),
        F.sum("revenue").alias("revenue"),
        F.when(level == 7, F.sum("units_sold")).alias("quantity"),
    )


def parent_totals(overview: DataFrame) -> DataFrame:
    """Revenue and share per parent category."""
    totals = (
        overview.where(F.col("type") == "cat")
        .groupBy("parent_category")
        .agg(F.sum("revenue").alias("revenue"))
    )
    # One row per parent category: the grand total is a window over that short list.
    everything = F.sum("revenue").over(Window.partitionBy(F.lit(1)))
    return totals.withColumn("share", ratio(F.col("revenue"), everything))


def category_flow(
    overview: DataFrame, top_categories: int = 20, top_brands: int = 30
) -> DataFrame:
    """Edges parent -> category -> brand for the largest categories and their brands.

    The brand totals are used several times, so they are stored once instead of
    being summed from the sales again in every branch.  The two short winner
    lists hold at most ``top_categories`` and ``top_brands`` rows, which bounds
    what is broadcast.
    """
    brands = cut_lineage(overview.where(F.col("type") == "brand"))
    categories = (
        brands.groupBy("parent_category", "category")
        .agg(F.sum("revenue").alias("total"))
        .orderBy(ranked_money("total").desc(), "parent_category", "category")
        .limit(top_categories)
    )
    kept = brands.join(
        F.broadcast(categories), ["parent_category", "category"], "left_semi"
    )
    winners = (
        kept.groupBy("brand")
        .agg(F.sum("revenue").alias("total"))
        .orderBy(ranked_money("total").desc(), "brand")
        .limit(top_brands)
    )
    kept = kept.join(F.broadcast(winners), "brand", "left_semi")
    upper = kept.groupBy("parent_category", "category").agg(F.sum("revenue").alias("value")).select(
        F.lit("parent_category").alias("level"),
        "parent_category",
        F.col("parent_category").alias("source"),
        F.col("category").alias("target"),
        "value",
    )
    lower = kept.select(
        F.lit("category_brand").alias("level"),
        "parent_category",
        F.col("category").alias("source"),
        F.col("brand").alias("target"),
        F.col("revenue").alias("value"),
    )
    return upper.unionByName(lower)


def category_rollup(pos: DataFrame, products: DataFrame, start: date) -> DataFrame:
    """Revenue and distinct orders per category of known products, from ``start`` on."""
    sold = pos.where((F.col("date") >= F.lit(start).cast("timestamp_ntz")) & (F.col("revenue") > 0))
    return (
        sold.join(products.select("product_id", "product_category"), "product_id")
        .groupBy("product_category")
        .agg(F.sum("revenue").alias("revenue"), F.countDistinct("order_id").alias("orders"))
        .orderBy(ranked_money("revenue").desc(), "product_category")
    )


def monthly_sales(pos: DataFrame, start: date) -> DataFrame:
    """Revenue and lines per month from ``start`` on."""
    return (
        pos.where(F.col("date") >= F.lit(start).cast("timestamp_ntz"))
        .groupBy(F.trunc("date", "month").alias("month"))
        .agg(F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("lines"))
        .orderBy("month")
    )


def range_totals(pos: DataFrame, start: date, end: date) -> DataFrame:
    """Line count and revenue of a date range."""
    return pos.where(day_range(F.col("date"), start, end)).agg(
        F.count(F.lit(1)).alias("lines"), zero_if_null(F.sum("revenue")).alias("revenue")
    )


def product_join_totals(pos: DataFrame, products: DataFrame, start: date) -> DataFrame:
    """Line count and revenue of known products from ``start`` on.

    The lines are reduced to products before the lookup.
    """
    sold = (
        pos.where(F.col("date") >= F.lit(start).cast("timestamp_ntz"))
        .groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("revenue").alias("revenue"))
    )
    return sold.join(products.select("product_id"), "product_id").agg(
        F.nvl(F.sum("lines"), F.lit(0)).alias("lines"),
        zero_if_null(F.sum("revenue")).alias("revenue"),
    )
