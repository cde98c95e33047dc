"""Lakes written from the given tables and read back: published versions, files of several types.

Days are the first days of months here, so that a lake of the whole tables has some eighty folders.
"""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, functions as F

from shelfledger.registry.core import register
from shelfledger.registry.tables import Tables
from shelfledger.schemas import AGG_SALES_DAILY, AGG_SALES_DAILY_BY_PRODUCT, column_names
from shelfledger.session import shared_folder
from shelfledger.sources.lake import Lake, write_days


def _lake(t: Tables) -> Lake:
    return Lake(t.spark, f"{shared_folder(t.spark).rstrip('/')}/lake-{uuid.uuid4().hex}")


def _monthly(df: DataFrame, *keys: str) -> DataFrame:
    """Sums of a daily aggregate by month, dated on its first day."""
    month = F.trunc("date", "month").alias("date")
    measures = [name for name in df.columns if name not in ("date", *keys)]
    return df.groupBy(month, *keys).agg(*[F.sum(name).alias(name) for name in measures])


class _Stopped(Exception):
    pass


@register(
    "lake_after_stopped_refresh",
    """
SELECT CAST(date_trunc('month', date) AS DATE) AS date,
       sum(revenue) * CASE WHEN year(date) = 1996 THEN 2 ELSE 1 END AS revenue,
       CAST(sum(transactions) AS BIGINT) AS transactions, sum(items_sold) AS items_sold,
       CAST(sum(lines) AS BIGINT) AS lines
FROM agg_sales_daily
GROUP BY date_trunc('month', date), year(date)
""",
    revenue=3,
    items_sold=3,
)
def _(t: Tables):
    """A first load, a refresh that stops halfway and leaves no trace, and one that ends."""
    lake, name = _lake(t), "agg_sales_daily"
    months = _monthly(t.agg_sales_daily)
    days = [row["date"] for row in t.calendar("month").collect()]
    lake.replace_days(lake.star(name), months, days)
    try:
        with lake.transaction():
            wrong = months.withColumn("revenue", F.lit(-1.0))
            lake.replace_days(lake.star(name), wrong, days)
            raise _Stopped
    except _Stopped:
        pass
    year = [day for day in days if day.year == 1996]
    lake.replace_days(lake.star(name), months.withColumn("revenue", F.col("revenue") * 2), year)
    return lake.table(name).select(*column_names(AGG_SALES_DAILY))


@register(
    "typed_view_of_three_generations",
    """
SELECT CAST(date_trunc('month', date) AS DATE) AS date, product_id,
       sum(revenue) AS revenue, sum(quantity) AS quantity,
       CASE WHEN year(date) < 1998 THEN 0 ELSE CAST(sum(lines) AS BIGINT) END AS lines
FROM agg_sales_daily_by_product
GROUP BY date_trunc('month', date), year(date), product_id
""",
    revenue=3,
    quantity=3,
)
def _(t: Tables):
    """Files of an older writer: numbers as text, then whole quantities without lines, then as declared."""
    lake, name = _lake(t), "agg_sales_daily_by_product"
    spec = column_names(AGG_SALES_DAILY_BY_PRODUCT)
    months = _monthly(t.agg_sales_by_product.select(*spec), "product_id")
    year = F.year("date")
    texts = [F.col(c).cast("string").alias(c) for c in ("product_id", "revenue", "quantity")]
    whole = F.col("quantity").cast("bigint").alias("quantity")
    for rows in (
        months.where(year < 1996).select("date", *texts),
        months.where(year.between(1996, 1997)).select("date", "product_id", "revenue", whole),
        months.where(year >= 1998),
    ):
        write_days(rows, lake.star(name))
    return lake.table(name).select(*spec)
