"""What a refresh has to load."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F


def newer_than(source: DataFrame, stored: DataFrame, column: str = "date") -> DataFrame:
    """Source rows after the last stored day; all rows when nothing is stored.

    The last stored day is a scalar subquery over the stored table, so the whole
    choice between full and incremental refresh is part of one plan.
    """
    watermark = stored.agg(F.max(F.col(column).cast("date"))).scalar()
    day = F.col(column).cast("date")
    return source.where(watermark.isNull() | (day > watermark))


def refresh_strategy(stored: DataFrame, column: str = "date") -> DataFrame:
    """One row: strategy (full or incremental) and the last stored day."""
    return stored.agg(F.max(F.col(column).cast("date")).alias("max_date")).select(
        F.when(F.col("max_date").isNull(), F.lit("full"))
        .otherwise(F.lit("incremental"))
        .alias("strategy"),
        "max_date",
    )


def days_to_load(source: DataFrame, stored: DataFrame, start: date, end: date) -> DataFrame:
    """Days in [start, end] that the source has and the stored table lacks."""

    def days(df: DataFrame) -> DataFrame:
        day = F.col("date").cast("date")
        return df.select(day.alias("date")).where(
            F.col("date").between(F.lit(start), F.lit(end))
        ).distinct()

    return days(source).join(days(stored), "date", "left_anti")
