"""ABC classes of products by revenue rank."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from shelfledger import constants as K
from shelfledger.functions.calendar import ordered
from shelfledger.functions.columns import product_label, ratio, zero_if_null
from shelfledger.functions.ranking import global_rank
from shelfledger.operators.sales import product_sales, ranked_money


def _share(value: float) -> float:
    return max(0.0, min(1.0, float(value or 0)))


def _cut(share: float, count: Column) -> Column:
    """Number of products in the first ``share`` of the ranking."""
    return F.ceil(F.lit(share) * count)


def abc_classes(
    by_product: DataFrame,
    products: DataFrame,
    start: date,
    end: date,
    a_share: float = K.ABC_A_SHARE,
    b_share: float = K.ABC_B_SHARE,
) -> DataFrame:
    """Rank, revenue shares and class of every product sold in the range.

    The ranking is distributed (see :func:`global_rank`); equal revenues are
    ordered by product id.
    """
    start, end = ordered(start, end)
    sold = product_sales(by_product, start, end).select(
        "product_id",
        zero_if_null(F.col("units_sold")).alias("units_sold"),
        zero_if_null(F.col("revenue")).alias("revenue"),
    )
    ranked = global_rank(
        sold, [ranked_money("revenue").desc(), F.col("product_id").asc()], "revenue"
    )
    rank, count, total = F.col("sku_rank"), F.col("sku_count"), F.col("total_revenue")
    a_cut = F.greatest(F.lit(1), _cut(_share(a_share), count))
    b_cut = F.greatest(a_cut, _cut(_share(b_share), count))
    has_revenue = total > 0
    names = products.select("product_id", "product_name", "product_category", "product_brand")
    return ranked.join(names, "product_id", "left").select(
        "product_id",
        product_label(F.col("product_name"), F.col("product_id")).alias("product_name"),
        F.nvl("product_category", F.lit(K.UNKNOWN_CATEGORY)).alias("product_category"),
        F.nvl("product_brand", F.lit(K.UNKNOWN_BRAND)).alias("product_brand"),
        "units_sold",
        "revenue",
        ratio(F.col("revenue"), total).alias("revenue_share"),
        F.when(has_revenue, F.col("cumulative_revenue"))
        .otherwise(F.lit(0.0))
        .alias("cumulative_revenue"),
        ratio(F.col("cumulative_revenue"), total).alias("cumulative_share"),
        rank.cast("bigint").alias("sku_rank"),
        (rank / count).alias("cumulative_sku_share"),
        F.when(rank <= a_cut, F.lit("A"))
        .when(rank <= b_cut, F.lit("B"))
        .otherwise(F.lit("C"))
        .alias("abc_class"),
        "total_revenue",
    )


def abc_summary(items: DataFrame) -> DataFrame:
    """SKU count, revenue and revenue share per class."""
    return (
        items.groupBy("abc_class")
        .agg(
            F.count(F.lit(1)).alias("sku_count"),
            F.sum("revenue").alias("revenue"),
            F.max("total_revenue").alias("total"),
        )
        .withColumn("revenue_share", ratio(F.col("revenue"), F.col("total")))
        .drop("total")
        .orderBy("abc_class")
    )


def abc_by_category(items: DataFrame) -> DataFrame:
    return items.groupBy("product_category", "abc_class").agg(F.sum("revenue").alias("revenue"))


def pareto(items: DataFrame, limit: int = 50) -> DataFrame:
    """First products of the ranking with their cumulative share of all revenue."""
    return (
        items.where(F.col("sku_rank") <= limit)
        .select("sku_rank", "product_id", "product_name", "revenue", "cumulative_share")
        .orderBy("sku_rank")
    )


def abc_mix(by_category: DataFrame, limit: int = 15) -> DataFrame:
    """Class revenues within the categories of highest revenue (a list of ``limit`` rows)."""
    best = (
        by_category.groupBy("product_category")
        .agg(F.sum("revenue").alias("total"))
        .orderBy(ranked_money("total").desc(), "product_category")
        .limit(limit)
    )
    return by_category.join(F.broadcast(best), "product_category", "left_semi").orderBy(
        "product_category", "abc_class"
    )
