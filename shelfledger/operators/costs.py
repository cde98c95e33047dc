"""Cost events, snapshots, history and as-of costs.

"Latest" always means the greatest (date, move, cost, tax), so ties are settled
the same way on every run.  It is computed as the maximum of a struct, which
combines on the map side: a product with a third of all events is reduced
before it is shuffled.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfledger.functions.columns import tax_multiplier

COST_COLUMNS = ("date", "product_id", "cost_unit_tax_in", "source_move_id", "source_tax_id")

# Label and priority of a purchase cost among all cost sources.
PURCHASE_SOURCE = "latest_purchase"
PURCHASE_PRIORITY = 1


def cost_events(purchases: DataFrame) -> DataFrame:
    """Tax-inclusive unit cost of every paid purchase line with goods."""
    return purchases.where(
        (F.col("product_id") != 0) & (F.col("actual_price") > 0) & (F.col("quantity") > 0)
    ).select(
        F.col("date").cast("date").alias("date"),
        "product_id",
        (F.col("actual_price") * tax_multiplier(F.col("tax_id"))).alias("cost_unit_tax_in"),
        F.col("move_id").alias("source_move_id"),
        F.nvl("tax_id", F.lit(0)).alias("source_tax_id"),
    )


def _newest(*leading: str) -> Column:
    return F.max(F.struct(*leading, "source_move_id", "cost_unit_tax_in", "source_tax_id"))


def _unpack(df: DataFrame, day: Column) -> DataFrame:
    return df.select(
        day.alias("date"),
        "product_id",
        "newest.cost_unit_tax_in",
        "newest.source_move_id",
        "newest.source_tax_id",
    )


def latest_cost_by_product(events: DataFrame) -> DataFrame:
    """Cost of the last purchase document per product, for events of one day."""
    latest = events.groupBy("product_id").agg(_newest().alias("newest"))
    return _unpack(latest, F.lit(None).cast("date")).drop("date")


def latest_cost_by_day(events: DataFrame) -> DataFrame:
    """One cost per product and day that has an event."""
    latest = events.groupBy("product_id", "date").agg(_newest().alias("newest"))
    return _unpack(latest, F.col("date"))


def cost_snapshot(events: DataFrame, as_of: date) -> DataFrame:
    """Last known cost per product on ``as_of``, from all events up to it."""
    latest = (
        events.where(F.col("date") <= F.lit(as_of))
        .groupBy("product_id")
        .agg(_newest("date").alias("newest"))
    )
    return _unpack(latest, F.lit(as_of))


def cost_snapshot_next(previous: DataFrame, today_events: DataFrame, day: date) -> DataFrame:
    """Snapshot of ``day`` from the snapshot before it and the day's own events.

    A product bought today takes today's cost, any other keeps its cost.  Both
    inputs are stacked and reduced once, in place of a full outer join.
    """
    carried = previous.select(F.lit(0).alias("fresh"), *COST_COLUMNS[1:])
    fresh = today_events.select(F.lit(1).alias("fresh"), *COST_COLUMNS[1:])
    latest = (
        carried.unionByName(fresh).groupBy("product_id").agg(_newest("fresh").alias("newest"))
    )
    return _unpack(latest, F.lit(day))


def cost_history(events: DataFrame, start: date, end: date) -> DataFrame:
    """Snapshots of every day in [start, end] in one job.

    Events before ``start`` shrink to one opening cost per product.  A product
    then has at most one row per calendar day, each valid until the next one.
    """
    by_day = (
        events.where(F.col("date") <= F.lit(end))
        .withColumn("valid_from", F.greatest("date", F.lit(start)))
        .groupBy("product_id", "valid_from")
        .agg(_newest("date").alias("newest"))
    )
    following = F.lead("valid_from").over(Window.partitionBy("product_id").orderBy("valid_from"))
    ranges = by_day.select(
        "product_id",
        "valid_from",
        F.nvl(F.date_sub(following, 1), F.lit(end)).alias("valid_to"),
        *[F.col(f"newest.{name}").alias(name) for name in COST_COLUMNS[2:]],
    )
    days = F.explode(F.sequence("valid_from", "valid_to", F.expr("interval 1 day")))
    return ranges.withColumn("date", days).select(*COST_COLUMNS)


def cost_intervals(events: DataFrame) -> DataFrame:
    """Full cost history as (valid_from, valid_to] change intervals.

    ``valid_to`` is the last day the cost holds, NULL for the current one.
    """
    daily = latest_cost_by_day(events)
    following = F.lead("date").over(Window.partitionBy("product_id").orderBy("date"))
    return daily.select(
        "product_id",
        F.col("date").alias("valid_from"),
        F.date_sub(following, 1).alias("valid_to"),
        "cost_unit_tax_in",
        "source_move_id",
        "source_tax_id",
    )


# --- late changes ---------------------------------------------------------------------


def changed_costs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(product_id, date) whose last cost of the day differs between two sets of events.

    Added, corrected and removed bills all show here; a bill that another one of the
    same day outranks changes nothing.  One shuffle of one row per product day.
    """
    newest = F.struct("source_move_id", "cost_unit_tax_in", "source_tax_id")

    def side(events: DataFrame, name: str) -> DataFrame:
        other = {"old": "new", "new": "old"}[name]
        kind = "struct<source_move_id:bigint,cost_unit_tax_in:double,source_tax_id:bigint>"
        return events.select(
            "product_id",
            "date",
            newest.cast(kind).alias(name),
            F.lit(None).cast(kind).alias(other),
        )

    return (
        side(before, "old")
        .unionByName(side(after, "new"))
        .groupBy("product_id", "date")
        .agg(F.max("old").alias("old"), F.max("new").alias("new"))
        .where(~F.col("old").eqNullSafe(F.col("new")))
        .select("product_id", "date")
    )


def dirty_ranges(changes: DataFrame, events: DataFrame, last: date) -> DataFrame:
    """(product_id, first_day, last_day) in which changed bills change the known cost.

    A change holds from its day to the day before the product's next purchase, at most to
    ``last``; ranges that touch are merged.  ``events`` are all events after the first change; only
    those of changed products are looked at, at most one row per product and calendar day.
    """
    touched = changes.select("product_id").distinct()
    marks = changes.select("product_id", "date", F.lit(True).alias("changed")).unionByName(
        events.join(touched, "product_id", "left_semi").select(
            "product_id", "date", F.lit(False).alias("changed")
        )
    )
    days = (
        marks.where(F.col("date") <= F.lit(last))
        .groupBy("product_id", "date")
        .agg(F.max("changed").alias("changed"))
    )
    order = Window.partitionBy("product_id").orderBy("date")
    opens = F.col("changed") & ~F.lag("changed", 1, False).over(order)
    following = F.lead("date").over(order)
    return (
        days.withColumns(
            {
                "_range": F.sum(opens.cast("int")).over(order),
                "_until": F.nvl(F.date_sub(following, 1), F.lit(last)),
            }
        )
        .where("changed")
        .groupBy("product_id", "_range")
        .agg(F.min("date").alias("first_day"), F.max("_until").alias("last_day"))
        .drop("_range")
    )


def cost_history_in(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """Snapshot rows of the product days in ``ranges``; days without a known cost have none.

    ``events`` hold what is known before and inside the ranges: a stored snapshot counts as the
    events of its day.  Costs become intervals, which are cut to the ranges and only then
    written out day by day.
    """
    wanted = events.join(ranges.select("product_id").distinct(), "product_id", "left_semi")
    known = latest_cost_by_day(wanted).withColumnRenamed("date", "valid_from")
    following = F.lead("valid_from").over(Window.partitionBy("product_id").orderBy("valid_from"))
    cut = (
        known.withColumn("valid_to", F.date_sub(following, 1))
        .join(ranges, "product_id")
        .withColumn("from", F.greatest("valid_from", "first_day"))
        .withColumn("to", F.least("valid_to", "last_day"))
        .where(F.col("from") <= F.col("to"))
    )
    days = F.explode(F.sequence("from", "to", F.expr("interval 1 day")))
    return cut.withColumn("date", days).select(*COST_COLUMNS)


def days_of(ranges: DataFrame) -> DataFrame:
    """(product_id, date) of every day of the ranges."""
    days = F.explode(F.sequence("first_day", "last_day", F.expr("interval 1 day")))
    return ranges.select("product_id", days.alias("date"))


def patched(stored: DataFrame, fresh: DataFrame, dirty: DataFrame) -> DataFrame:
    """``stored`` with the rows of dirty product days replaced by ``fresh``."""
    marks = dirty.select("product_id", "date", F.lit(True).alias("_dirty"))
    kept = stored.join(marks, ["product_id", "date"], "left").where(F.col("_dirty").isNull())
    return kept.select(*stored.columns).unionByName(fresh.select(*stored.columns))


# --- unified cost --------------------------------------------------------------------


def _candidates(purchase_costs: DataFrame, legacy: DataFrame) -> DataFrame:
    bought = purchase_costs.where(F.col("cost_unit_tax_in") > 0).select(
        "product_id",
        F.lit(PURCHASE_PRIORITY).alias("priority"),
        F.col("date").alias("effective_date"),
        "source_move_id",
        "cost_unit_tax_in",
        "source_tax_id",
        F.lit(PURCHASE_SOURCE).alias("cost_source"),
    )
    inherited = legacy.where(F.col("is_active") & (F.col("cost_unit_tax_in") > 0)).select(
        "product_id",
        F.nvl("priority", F.lit(3)).cast("int").alias("priority"),
        "effective_date",
        F.lit(0).cast("bigint").alias("source_move_id"),
        "cost_unit_tax_in",
        "source_tax_id",
        "cost_source",
    )
    return bought.unionByName(inherited)


def _preferred() -> Column:
    """Orders candidates: lowest priority number, latest effective date, last document."""
    return F.struct(
        (-F.col("priority")).alias("rank"),
        "effective_date",
        "source_move_id",
        "cost_unit_tax_in",
        "source_tax_id",
        "cost_source",
    )


def unified_cost(
    purchase_costs: DataFrame, legacy: DataFrame, as_of: date | None = None
) -> DataFrame:
    """Best cost per product among purchase and legacy costs.

    ``purchase_costs`` are daily snapshots or, equally, the cost events themselves.
    Candidates after ``as_of`` are left out before the best one is chosen, so a
    later purchase does not hide the cost that was known on that day.
    """
    candidates = _candidates(purchase_costs, legacy)
    if as_of is not None:
        candidates = candidates.where(F.col("effective_date") <= F.lit(as_of))
    return (
        candidates.groupBy("product_id")
        .agg(F.max(_preferred()).alias("best"))
        .select(
            "product_id",
            "best.cost_unit_tax_in",
            "best.source_tax_id",
            "best.cost_source",
            "best.effective_date",
        )
    )


def _known_on(offers: DataFrame, asked: DataFrame, known: Column) -> DataFrame:
    """Carry offers forward to the asked (product_id, date) pairs.

    ``offers`` has one ``best`` per product and day; ``known`` picks the one that
    holds from the rows seen so far.  Sales arrive here as distinct product days,
    so a product has at most two rows per calendar day in the ordered pass,
    however many events and sales it has.  No range join is needed.
    """
    marks = asked.select("product_id", "date").distinct()
    seen = (
        Window.partitionBy("product_id")
        .orderBy("date", "asked")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        offers.select("product_id", "date", "best", F.lit(False).alias("asked"))
        .unionByName(
            marks.select(
                "product_id", "date", F.lit(None).alias("best"), F.lit(True).alias("asked")
            )
        )
        .withColumn("best", known.over(seen))
        .where(F.col("asked") & F.col("best").isNotNull())
    )


def unified_cost_by_day(
    events: DataFrame, legacy: DataFrame, product_days: DataFrame
) -> DataFrame:
    """Unified cost of each (product_id, date) in ``product_days``, as known that day.

    A running maximum of the candidates seen so far.  Days without a known cost
    are left out.  ``product_days`` may hold repeated rows.
    """
    offers = (
        _candidates(events, legacy)
        .groupBy("product_id", F.col("effective_date").alias("date"))
        .agg(F.max(_preferred()).alias("best"))
    )
    return _known_on(offers, product_days, F.max("best")).select(
        "product_id",
        "date",
        "best.cost_unit_tax_in",
        "best.source_tax_id",
        "best.cost_source",
        "best.effective_date",
    )


def unified_cost_intervals(events: DataFrame, legacy: DataFrame) -> DataFrame:
    """The unified cost of every product as intervals (valid_from, valid_to), the last one open.

    The same rule as :func:`unified_cost_by_day`, for all days at once and without looking at any sale: a
    running maximum over at most one offer per product and day.
    """
    offers = (
        _candidates(events, legacy)
        .groupBy("product_id", F.col("effective_date").alias("valid_from"))
        .agg(F.max(_preferred()).alias("offer"))
    )
    order = Window.partitionBy("product_id").orderBy("valid_from")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = offers.select(
        "product_id",
        "valid_from",
        F.date_sub(F.lead("valid_from").over(order), 1).alias("valid_to"),
        F.max("offer").over(so_far).alias("best"),
    )
    return known.select(
        "product_id",
        "valid_from",
        "valid_to",
        "best.cost_unit_tax_in",
        "best.source_tax_id",
        "best.cost_source",
        "best.effective_date",
    )


def cost_as_of(events: DataFrame, product_days: DataFrame) -> DataFrame:
    """Most recent purchase cost on or before each (product_id, date)."""
    offers = events.groupBy("product_id", "date").agg(_newest().alias("best"))
    known = _known_on(offers, product_days, F.last("best", ignorenulls=True))
    return _unpack(known.withColumnRenamed("best", "newest"), F.col("date"))


# --- inventory cost ------------------------------------------------------------------


def inventory_cost(purchase_costs: DataFrame, beginning: DataFrame, as_of: date) -> DataFrame:
    """Unit cost per product on ``as_of``: latest purchase cost, else opening cost.

    ``purchase_costs`` are daily snapshots or the cost events themselves.
    """
    bought = purchase_costs.where(
        (F.col("date") <= F.lit(as_of)) & (F.col("cost_unit_tax_in") > 0)
    ).select("product_id", F.lit(1).alias("rank"), "date", "source_move_id", "cost_unit_tax_in")
    opening = beginning.where(
        F.col("is_active")
        & (F.col("effective_date") <= F.lit(as_of))
        & (F.col("cost_unit_tax_in") > 0)
    ).select(
        "product_id",
        F.lit(0).alias("rank"),
        F.col("effective_date").alias("date"),
        F.lit(0).cast("bigint").alias("source_move_id"),
        "cost_unit_tax_in",
    )
    return (
        bought.unionByName(opening)
        .groupBy("product_id")
        .agg(F.max(F.struct("rank", "date", "source_move_id", "cost_unit_tax_in")).alias("best"))
        .select("product_id", "best.cost_unit_tax_in")
    )
