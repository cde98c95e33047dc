"""Data checks: column rules, profit consistency, day coverage and gaps.

Day-level frames hold at most one row per calendar day and table, which bounds
the few windows over a whole calendar.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfledger.functions.calendar import calendar

# --- validators ----------------------------------------------------------------------------


def missing_columns(df: DataFrame, expected: Sequence[str]) -> list[str]:
    present = set(df.columns)
    return [name for name in expected if name not in present]


def validate(
    df: DataFrame,
    expected: Sequence[str] = (),
    not_null: Sequence[str] = (),
    min_rows: int = 1,
    date_column: str | None = None,
    min_date: date | None = None,
    max_date: date | None = None,
) -> DataFrame:
    """One row per rule: (rule, subject, violations, passed), from a single aggregate."""
    spark = df.sparkSession
    absent = missing_columns(df, [*expected, *not_null, *([date_column] if date_column else [])])
    measured: list[tuple[str, str, Column]] = []
    for name in not_null:
        if name not in absent:
            measured.append(("no_nulls", name, F.count_if(F.col(name).isNull())))
    short = F.greatest(F.lit(min_rows) - F.count(F.lit(1)), F.lit(0))
    measured.append(("min_rows", str(min_rows), short))
    if date_column and date_column not in absent:
        day = F.col(date_column).cast("date")
        outside = F.lit(False)
        if min_date is not None:
            outside = outside | (day < F.lit(min_date))
        if max_date is not None:
            outside = outside | (day > F.lit(max_date))
        empty = F.when(F.count(day) == 0, F.lit(1)).otherwise(F.lit(0))
        measured.append(("date_range", date_column, F.count_if(outside) + empty))
    results = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(rule).alias("rule"),
                    F.lit(subject).alias("subject"),
                    count.cast("bigint").alias("violations"),
                )
                for rule, subject, count in measured
            ]
        ).alias("r")
    ).select(F.inline("r"))
    schema_rows = [
        ("schema", name, 1 if name in absent else 0)
        for name in dict.fromkeys([*expected, *not_null, *([date_column] if date_column else [])])
    ]
    if schema_rows:
        results = results.unionByName(
            spark.createDataFrame(schema_rows, "rule string, subject string, violations bigint")
        )
    return results.withColumn("passed", F.col("violations") == 0)


# --- profit consistency ----------------------------------------------------------------------

TOLERANCE = 0.01


def _differs(left: Column, right: Column) -> Column:
    return F.nvl(F.abs(left - right) > TOLERANCE, F.lit(False))


def profit_line_checks(lines: DataFrame) -> DataFrame:
    """Rule violations of profit lines per day, with a verdict."""
    revenue, cogs, profit = F.col("revenue_tax_in"), F.col("cogs_tax_in"), F.col("gross_profit")
    checked = lines.groupBy("date").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(_differs(profit, revenue - cogs)).alias("profit_mismatch"),
        F.count_if(_differs(cogs, F.col("cost_unit_tax_in") * F.col("quantity"))).alias(
            "cogs_mismatch"
        ),
        F.count_if(profit.isNull()).alias("null_profit"),
        F.count_if(cogs < 0).alias("negative_cogs"),
    )
    problems = (
        F.col("profit_mismatch")
        + F.col("cogs_mismatch")
        + F.col("null_profit")
        + F.col("negative_cogs")
    )
    return checked.withColumn(
        "status", F.when(problems == 0, F.lit("VALID")).otherwise(F.lit("INVALID"))
    )


def cost_event_checks(events: DataFrame) -> DataFrame:
    """Events that should not exist: no positive cost, or no product."""
    return events.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(~(F.col("cost_unit_tax_in") > 0)).alias("non_positive_cost"),
        F.count_if(F.col("product_id") == 0).alias("no_product"),
    )


def daily_total_checks(lines: DataFrame, daily: DataFrame) -> DataFrame:
    """Days on which a daily aggregate and its lines disagree.

    Both sides are stacked with opposite signs and summed per day.
    """
    names = ("revenue_tax_in", "cogs_tax_in", "gross_profit", "quantity")
    line_side = lines.select("date", *names, F.lit(1).alias("lines"))
    day_side = daily.select("date", *[(-F.col(name)).alias(name) for name in (*names, "lines")])
    gaps = (
        line_side.unionByName(day_side)
        .groupBy("date")
        .agg(*[F.sum(name).alias(name) for name in (*names, "lines")])
    )
    wrong = F.col("lines") != 0
    for name in names:
        wrong = wrong | (F.abs(F.nvl(F.col(name), F.lit(0.0))) > TOLERANCE)
    return gaps.select("date", F.nvl(wrong, F.lit(True)).alias("mismatch"))


# --- coverage --------------------------------------------------------------------------------


def day_counts(df: DataFrame, column: str = "date") -> DataFrame:
    """Rows per day."""
    return df.groupBy(F.col(column).cast("date").alias("date")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def coverage(
    tables: Mapping[str, DataFrame],
    start: date,
    end: date,
    files: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """(date, table, status, rows) for every day and table.

    ``tables`` maps a name to a frame with a ``date`` column.  ``files`` may map a
    name to the days that have a file; a day with a file but no row is ``Empty``.
    """
    files = files or {}
    spark = next(iter(tables.values())).sparkSession
    grid = calendar(spark, start, end).select(
        "date", F.explode(F.array(*[F.lit(name) for name in tables])).alias("table")
    )
    found = None
    for name, df in tables.items():
        part = day_counts(df).select("date", F.lit(name).alias("table"), "rows")
        found = part if found is None else found.unionByName(part)
        if name in files:
            listed = files[name].select(
                "date", F.lit(name).alias("table"), F.lit(0).cast("bigint").alias("rows")
            )
            found = found.unionByName(listed)
    present = found.groupBy("date", "table").agg(F.sum("rows").alias("rows"))
    return (
        grid.join(present, ["date", "table"], "left")
        .select(
            "date",
            "table",
            F.when(F.col("rows").isNull(), F.lit("Missing"))
            .when(F.col("rows") == 0, F.lit("Empty"))
            .otherwise(F.lit("OK"))
            .alias("status"),
            F.nvl("rows", F.lit(0)).alias("rows"),
        )
        .orderBy("date", "table")
    )


def layer_status(
    layers: Mapping[str, DataFrame], start: date, end: date
) -> DataFrame:
    """(date, then status and rows of each layer) for every day: raw, clean and fact side by side.

    ``layers`` maps a layer to its (date, rows), where 0 rows stand for a day that is stored and empty.
    """
    spark = next(iter(layers.values())).sparkSession
    stacked = None
    for name, counts in layers.items():
        part = counts.select("date", F.lit(name).alias("layer"), "rows")
        stacked = part if stacked is None else stacked.unionByName(part)
    wide = stacked.groupBy("date").agg(
        *[F.sum(F.when(F.col("layer") == name, F.col("rows"))).alias(name) for name in layers]
    )
    columns = ["date"]
    for name in layers:
        rows = F.col(name)
        status = F.when(rows.isNull(), F.lit("Missing")).when(rows == 0, F.lit("Empty"))
        columns.append(status.otherwise(F.lit("OK")).alias(f"{name}_status"))
        columns.append(F.nvl(rows, F.lit(0)).alias(f"{name}_rows"))
    days = calendar(spark, start, end).select("date")
    return days.join(wide, "date", "left").select(*columns).orderBy("date")


def table_status(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, status, rows) of undated tables such as dimensions: ``Empty`` or ``OK``."""
    counts = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        counts = part if counts is None else counts.unionByName(part)
    status = F.when(F.col("rows") == 0, F.lit("Empty")).otherwise(F.lit("OK"))
    return counts.select("table", status.alias("status"), "rows")


def date_ranges(days: DataFrame) -> DataFrame:
    """Consecutive days merged to (start_date, end_date, days).  Input: distinct ``date``."""
    island = F.date_sub(F.col("date"), F.row_number().over(Window.orderBy("date")))
    return (
        days.withColumn("island", island)
        .groupBy("island")
        .agg(
            F.min("date").alias("start_date"),
            F.max("date").alias("end_date"),
            F.count(F.lit(1)).alias("days"),
        )
        .drop("island")
        .orderBy("start_date")
    )


def missing_ranges(df: DataFrame, start: date, end: date, column: str = "date") -> DataFrame:
    """Ranges of calendar days in [start, end] without a row."""
    present = df.select(F.col(column).cast("date").alias("date")).distinct()
    return date_ranges(calendar(df.sparkSession, start, end).join(present, "date", "left_anti"))


def _sync_days(source: DataFrame, derived: DataFrame, start: date, end: date) -> DataFrame:
    """(date, in_source, in_derived) for days on either side."""

    def side(df: DataFrame, in_source: bool) -> DataFrame:
        day = F.col("date").cast("date")
        return (
            df.select(day.alias("date"))
            .where(F.col("date").between(F.lit(start), F.lit(end)))
            .distinct()
            .select(
                "date",
                F.lit(in_source).alias("in_source"),
                F.lit(not in_source).alias("in_derived"),
            )
        )

    return (
        side(source, True)
        .unionByName(side(derived, False))
        .groupBy("date")
        .agg(F.max("in_source").alias("in_source"), F.max("in_derived").alias("in_derived"))
    )


def sync_differences(source: DataFrame, derived: DataFrame, start: date, end: date) -> DataFrame:
    """Days missing in the derived table, or orphaned there."""
    return (
        _sync_days(source, derived, start, end)
        .where(F.col("in_source") != F.col("in_derived"))
        .select(
            "date",
            F.when(F.col("in_source"), F.lit("missing"))
            .otherwise(F.lit("orphaned"))
            .alias("difference"),
        )
    )


def sync_status(
    source: DataFrame, derived: DataFrame | None, start: date, end: date
) -> DataFrame:
    """One row: day counts on both sides, differences and a verdict."""
    spark = source.sparkSession
    exists = derived is not None
    other = derived if exists else spark.createDataFrame([], "date date")
    src, drv = F.col("in_source"), F.col("in_derived")
    counts = _sync_days(source, other, start, end).agg(
        F.count_if(src).alias("source_days"),
        F.count_if(drv).alias("derived_days"),
        F.count_if(src & ~drv).alias("missing_days"),
        F.count_if(drv & ~src).alias("orphaned_days"),
    )
    missing, orphaned = F.col("missing_days") > 0, F.col("orphaned_days") > 0
    return counts.withColumn(
        "status",
        F.when(F.lit(not exists), F.lit("MISSING"))
        .when(~missing & ~orphaned, F.lit("SYNCED"))
        .when(missing & ~orphaned, F.lit("STALE"))
        .when(orphaned & ~missing, F.lit("ORPHANED"))
        .otherwise(F.lit("MIXED")),
    )


def days_behind(df: DataFrame, as_of: date, column: str = "date") -> DataFrame:
    """One row: last day with data, days behind ``as_of``, health."""
    behind = F.date_diff(F.lit(as_of), F.col("last_date"))
    return df.agg(F.max(F.col(column).cast("date")).alias("last_date")).select(
        "last_date",
        behind.alias("days_behind"),
        F.when(F.col("last_date").isNull(), F.lit("unknown"))
        .when(behind <= 1, F.lit("healthy"))
        .otherwise(F.lit("unhealthy"))
        .alias("status"),
    )
