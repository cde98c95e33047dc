"""From raw records to facts, costs, profit and aggregates.

Every job replaces the days of a range, so running it again gives the same
lake.  A daily run is a range of one day; a backfill or a catch-up is the same
job with a longer range, not a loop over days.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from shelfledger import constants as K
from shelfledger.functions.calendar import calendar
from shelfledger.functions.columns import parse_day, parse_second
from shelfledger.operators import cleaning, costs, profit, quality, refresh, sales, sell_through, stock
from shelfledger.operators.shaping import normalise
from shelfledger.schemas import COST_ROWS, FACT_STOCK_SNAPSHOT, PROFIT_LINES, RAW_TABLES
from shelfledger.session import cut_lineage
from shelfledger.sources.files import read_beginning_costs
from shelfledger.sources.lake import FOLDER_DAY, Lake

# Raw dataset -> text column with the record's day.
RAW_DAYS = {
    "pos_order_lines": "order_date",
    "account_move_out_invoice_lines": "move_date",
    "account_move_in_invoice_lines": "move_date",
    "inventory_moves": "movement_date",
    "stock_quants": "snapshot_date",
}

# The table that run_range writes last.
LAST_TABLE = "agg_profit_daily_by_product"
LEDGER_CLOSES = "fact_stock_ledger_close"
EVENTS, SNAPSHOTS = "fact_product_cost_events", "fact_product_cost_latest_daily"


def save_raw(lake: Lake, dataset: str, records: DataFrame, start: date, end: date) -> None:
    """Store extracted records of a range of days, normalised, by their own day.

    No record is lost: one with a readable day outside the range is an error and nothing is written.
    One whose day cannot be read goes to the folder of ``K.UNKNOWN_DAY``, which does not depend on the call and
    keeps what earlier calls put there; an identical record is kept once.
    """
    spec, column = RAW_TABLES[dataset], RAW_DAYS[dataset]
    rows = normalise(records, spec).withColumn(
        FOLDER_DAY, F.substring(column, 1, 10).try_cast("date")
    )
    known = F.col(FOLDER_DAY).isNotNull()
    counts = rows.agg(
        F.count_if(known & ~F.col(FOLDER_DAY).between(F.lit(start), F.lit(end))).alias("outside"),
        F.count_if(~known).alias("unknown"),
    ).first()
    if counts["outside"]:
        raise ValueError(f"{dataset}: {counts['outside']} records are not from {start} to {end}")
    with lake.transaction():
        lake.replace_days(lake.raw(dataset), rows.where(known), _days(start, end), FOLDER_DAY)
        if counts["unknown"]:
            earlier = _raw(lake, dataset, K.UNKNOWN_DAY, K.UNKNOWN_DAY).drop(FOLDER_DAY)
            unknown = rows.where(~known).drop(FOLDER_DAY).unionByName(earlier).distinct()
            unknown = cut_lineage(unknown.withColumn(FOLDER_DAY, F.lit(K.UNKNOWN_DAY)))
            lake.replace_days(lake.raw(dataset), unknown, [K.UNKNOWN_DAY], FOLDER_DAY)


def _days(start: date, end: date) -> list[date]:
    return [start + timedelta(days=k) for k in range((end - start).days + 1)]


def _raw(lake: Lake, dataset: str, start: date, end: date) -> DataFrame:
    """Stored records of the folders in [start, end], with their folder day."""
    spec = [*RAW_TABLES[dataset], (FOLDER_DAY, "date", None)]
    return lake.read(lake.raw(dataset), spec, _days(start, end))


def _load(
    lake: Lake,
    dataset: str,
    table: str,
    clean: Callable[[DataFrame], DataFrame],
    start: date,
    end: date,
    *,
    day: str = "date",
    margin: int = 0,
    zone: str | None = None,
) -> None:
    """Replace the days of the clean layer and of a fact table.

    The clean rows are stored once and the fact is read from them.  A record with an unreadable date takes
    its folder's day.  Records of the unknown day are loaded as well, into the unknown day of the table.
    """
    column = RAW_DAYS[dataset]
    ranges = [(start, end)]
    paths = (lake.raw(dataset), lake.star(table))
    if any(K.UNKNOWN_DAY in lake.versions(path) for path in paths) and not start <= K.UNKNOWN_DAY <= end:
        ranges.append((K.UNKNOWN_DAY, K.UNKNOWN_DAY))
    for first, last in ranges:
        around = timedelta(days=margin)
        raw = _raw(lake, dataset, first - around, last + around)
        text = F.col(column)
        if zone is None:
            readable = text.rlike(r"^\d{4}-\d{2}-\d{2}") & F.substring(text, 1, 10).try_cast("date").isNotNull()
            if dataset != "inventory_moves":
                readable = parse_day(text).isNotNull()
            shown = F.date_format(FOLDER_DAY, "yyyy-MM-dd")
        else:  # local midnight of the folder day, as UTC text
            readable = parse_second(text).isNotNull()
            midnight = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col(FOLDER_DAY).cast("timestamp_ntz"))
            shown = F.date_format(midnight, "yyyy-MM-dd HH:mm:ss")
        raw = raw.withColumn(column, F.when(F.nvl(readable, F.lit(False)), text).otherwise(shown))
        stored = lake.clean(dataset)
        lake.replace_days(stored, clean(raw.drop(FOLDER_DAY)), _days(first, last), day)
        rows = lake.read_as_written(stored, _days(first, last))
        lake.replace(table, cleaning.load_fact(rows, table), first, last, day)


def load_sales(lake: Lake, start: date, end: date, zone: str = K.LOCAL_ZONE) -> None:
    """POS facts by local day.  A local day touches the UTC days on both sides of it."""
    _load(
        lake, "pos_order_lines", "fact_sales",
        lambda raw: cleaning.clean_pos(raw, zone), start, end, margin=1, zone=zone,
    )


def load_invoices(lake: Lake, start: date, end: date) -> None:
    _load(
        lake, "account_move_out_invoice_lines", "fact_invoice_sales",
        cleaning.clean_invoices, start, end,
    )


def load_purchases(lake: Lake, start: date, end: date) -> None:
    _load(
        lake, "account_move_in_invoice_lines", "fact_purchases", cleaning.clean_bills, start, end
    )


def load_moves(lake: Lake, start: date, end: date) -> None:
    dimensions = [
        lake.table(name) for name in ("dim_products", "dim_locations", "dim_uoms", "dim_partners")
    ]
    _load(
        lake, "inventory_moves", "fact_inventory_moves",
        lambda raw: cleaning.clean_moves(raw, *dimensions), start, end,
    )


def load_quants(lake: Lake, start: date, end: date) -> None:
    _load(
        lake, "stock_quants", "fact_stock_on_hand_snapshot",
        cleaning.clean_quants, start, end, day="snapshot_date",
    )


# Fact table -> raw dataset it is loaded from.
FACT_SOURCES = {
    "fact_sales": "pos_order_lines",
    "fact_invoice_sales": "account_move_out_invoice_lines",
    "fact_purchases": "account_move_in_invoice_lines",
    "fact_inventory_moves": "inventory_moves",
    "fact_stock_on_hand_snapshot": "stock_quants",
}


def day_status(lake: Lake, table: str, start: date, end: date) -> DataFrame:
    """Status and rows of a fact's raw, clean and fact layers on every day of the range."""
    dataset = FACT_SOURCES[table]
    paths = {"raw": lake.raw(dataset), "clean": lake.clean(dataset), "fact": lake.star(table)}
    counts = {layer: lake.row_counts(path, start, end) for layer, path in paths.items()}
    return quality.layer_status(counts, start, end)


def load_dimension(lake: Lake, name: str, df: DataFrame) -> None:
    lake.replace_flat(name, df)


def load_beginning_costs(lake: Lake, csv_path: str) -> None:
    """Checked opening costs; a later file replaces the earlier one."""
    lake.replace_flat("fact_product_beginning_costs", read_beginning_costs(lake.spark, csv_path))


# --- costs ---------------------------------------------------------------------------------


def update_cost_events(lake: Lake, start: date, end: date) -> None:
    events = costs.cost_events(lake.table("fact_purchases", start, end))
    lake.replace("fact_product_cost_events", events, start, end)


def update_cost_snapshots(lake: Lake, start: date, end: date) -> DataFrame:
    """Snapshots of the range, and of every later stored day that its bills reach.

    Returns the dirty ranges (product_id, first_day, last_day): product days before and after the range's
    end whose known cost has changed.  Call it in the transaction that replaced the events, so
    that their former state is still there to compare with.

    A stored day is patched: only days with a changed cost are written, and only its
    dirty product days are computed.  A new day starts from the stored snapshot before it.  Events are read from
    there on, never from the beginning, unless nothing is stored before the range.
    """
    path = lake.star(SNAPSHOTS)
    stored = [day for day in lake.versions(path, pending=False) if day != K.UNKNOWN_DAY]
    asked = [day for day in _days(start, end) if day != K.UNKNOWN_DAY]
    if K.UNKNOWN_DAY in _days(start, end):  # a day of its own: its costs reach no other day
        known = lake.table(EVENTS, K.UNKNOWN_DAY, K.UNKNOWN_DAY)
        snapshot = costs.cost_snapshot(known, K.UNKNOWN_DAY)
        lake.replace_days(path, snapshot, [K.UNKNOWN_DAY])
    if not asked:
        return lake.spark.createDataFrame([], RANGES)
    start, end = asked[0], asked[-1]
    last = max([*stored, end])
    changes = costs.changed_costs(
        lake.published(EVENTS, start, end), lake.table(EVENTS, start, end)
    )
    ranges = costs.dirty_ranges(changes, lake.table(EVENTS, start, last), last)
    ranges = cut_lineage(ranges)  # small, and used for snapshots, lines and aggregates
    later = [day for day in stored if start <= day]
    reached = _reached(ranges, later)
    if reached:
        base = _known_before(lake, start, last)
        dirty = costs.days_of(ranges)
        fresh = costs.cost_history_in(base, ranges)
        rows = costs.patched(lake.read(path, COST_ROWS, reached), fresh, dirty)
        lake.replace_days(path, rows, reached)
    for first, final in _runs(sorted(set(asked) - set(stored))):
        rows = costs.cost_history(_known_before(lake, first, final), first, final)
        lake.replace_days(path, rows, _days(first, final))
    return ranges


RANGES = "product_id bigint, first_day date, last_day date"


def _known_before(lake: Lake, first: date, last: date) -> DataFrame:
    """What fixes the costs of [first, last]: the last stored snapshot before, and the events since."""
    stored = lake.versions(lake.star(SNAPSHOTS))
    before = max((d for d in stored if d < first and d != K.UNKNOWN_DAY), default=None)
    if before is None:
        everything = lake.table(EVENTS, None, last)
        return everything.where(F.col("date") != F.lit(K.UNKNOWN_DAY))
    since = lake.table(EVENTS, before + timedelta(days=1), last)
    return lake.table(SNAPSHOTS, before, before).unionByName(since)


def _reached(ranges: DataFrame, days: list[date]) -> list[date]:
    """The given days that lie in a range.  Distinct days come to the driver, never products."""
    if not days:
        return []
    inside = costs.days_of(ranges).select("date").distinct()
    found = {row["date"] for row in inside.collect()}
    return sorted(found & set(days))


def _runs(days: list[date]) -> list[tuple[date, date]]:
    """Consecutive days merged to (first, last)."""
    runs: list[tuple[date, date]] = []
    for day in days:
        if runs and day - runs[-1][1] == timedelta(days=1):
            runs[-1] = (runs[-1][0], day)
        else:
            runs.append((day, day))
    return runs


# --- profit and aggregates -------------------------------------------------------------------


def _profit_lines(
    lake: Lake, shop: DataFrame, billed: DataFrame, day_costs: DataFrame, zero_missing_cost: bool
) -> DataFrame:
    return profit.line_profit_by_day(
        profit.taxed_sales(shop, billed),
        day_costs,
        lake.table("fact_product_legacy_costs"),
        zero_missing_cost,
    )


def update_profit_lines(lake: Lake, start: date, end: date, zero_missing_cost: bool = False) -> None:
    """Profit per sales line; costs are the snapshots of the range and legacy costs."""
    lines = _profit_lines(
        lake,
        lake.table("fact_sales", start, end),
        lake.table("fact_invoice_sales", start, end),
        lake.table(SNAPSHOTS, start, end),
        zero_missing_cost,
    )
    lake.replace("fact_sales_lines_profit", lines, start, end)


def update_dirty_profit(
    lake: Lake, ranges: DataFrame, after: date, zero_missing_cost: bool = False
) -> list[date]:
    """Profit of the stored days behind ``after`` whose costs have changed; returns the days written.

    Only lines of dirty product days are computed again, and only days that sold such a product are
    written, with their aggregates.
    """
    table = lake.star("fact_sales_lines_profit")
    later = [day for day in lake.versions(table) if day > after and day != K.UNKNOWN_DAY]
    days = _reached(ranges, later)
    if not days:
        return []
    dirty = cut_lineage(costs.days_of(ranges).where(F.col("date").isin(days)))
    stored = lake.read(table, _AS_WRITTEN, days)
    sold = stored.join(dirty, ["product_id", "date"], "left_semi").select("date").distinct()
    days = sorted(row["date"] for row in sold.collect())
    if not days:
        return []
    first, last = days[0], days[-1]

    def of_dirty(df: DataFrame) -> DataFrame:
        keyed = df.withColumns({"_p": F.nvl("product_id", F.lit(0)), "_d": F.col("date").cast("date")})
        keys = dirty.select(F.col("product_id").alias("_p"), F.col("date").alias("_d"))
        return keyed.join(keys, ["_p", "_d"], "left_semi").drop("_p", "_d")

    fresh = _profit_lines(
        lake,
        of_dirty(lake.table("fact_sales", first, last)),
        of_dirty(lake.table("fact_invoice_sales", first, last)),
        lake.table(SNAPSHOTS, first, last).join(dirty, ["product_id", "date"], "left_semi"),
        zero_missing_cost,
    )
    rows = costs.patched(lake.read(table, _AS_WRITTEN, days), fresh, dirty)
    lake.replace_days(table, rows, days)
    for some in _runs(days):
        update_profit_aggregates(lake, *some)
    return days


def update_profit_aggregates(lake: Lake, start: date, end: date) -> None:
    """Aggregates of the stored lines, which are not computed again.

    The stored file keeps channel, missing-cost mark and NULLs that the typed view
    of the lines fills, so it is read as written.
    """
    lines = lake.read(lake.star("fact_sales_lines_profit"), _AS_WRITTEN, _days(start, end))
    lake.replace("agg_profit_daily", profit.profit_daily(lines), start, end)
    lake.replace(
        "agg_profit_daily_by_product", profit.profit_daily_by_product(lines), start, end
    )


_AS_WRITTEN = [
    *[(name, kind, None) for name, kind, _ in PROFIT_LINES],
    ("channel", "string", ""),
    ("cost_missing", "boolean", None),
]


def update_sales_aggregates(lake: Lake, start: date, end: date) -> None:
    """Three aggregates; the brand one is rolled up from the stored product one."""
    lines = sales.combined_sales(
        lake.table("fact_sales", start, end), lake.table("fact_invoice_sales", start, end)
    )
    lake.replace("agg_sales_daily", sales.sales_daily(lines), start, end)
    lake.replace("agg_sales_daily_by_product", sales.sales_daily_by_product(lines), start, end)
    by_principal = sales.sales_daily_by_principal(
        lake.table("agg_sales_daily_by_product", start, end), lake.table("dim_products")
    )
    lake.replace("agg_sales_daily_by_principal", by_principal, start, end)


# --- stock ledger ------------------------------------------------------------------------------


def update_ledger_closes(
    lake: Lake,
    baseline: DataFrame,
    start: date,
    end: date,
    baseline_local: datetime = K.LEDGER_BASELINE_LOCAL,
    pool: Iterable[int] = K.LEDGER_LOCATION_POOL,
    zone: str = K.LOCAL_ZONE,
) -> list[date]:
    """Closing stock on the first of each month that moves of [start, end] reach; returns the days written.

    Starts from the last close before the range, or from the opening stock, and goes on to the last stored close,
    so late moves reach every close behind them.  Moves before that close are not read.
    """
    closed = lake.days(LEDGER_CLOSES)
    last = max([*closed, end])
    firsts = [day for day in _days(start, last) if day.day == 1]
    days = [day for day in firsts if stock.close_of(day) > baseline_local]
    if not days:
        return []
    opening, opened = _ledger_opening(lake, baseline, days[0], baseline_local)
    moves = lake.table("fact_inventory_moves", opened.date() - timedelta(days=1), last)
    rows = stock.ledger_closes(opening, moves, opened, days, pool, zone)
    lake.replace_days(lake.star(LEDGER_CLOSES), rows, days)
    return days


def _ledger_opening(
    lake: Lake, baseline: DataFrame, before: date, baseline_local: datetime
) -> tuple[DataFrame, datetime]:
    """(product_id, qty) of the last close before a day, or the opening stock, and its local moment."""
    closed = [d for d in lake.days(LEDGER_CLOSES) if d < before and stock.close_of(d) > baseline_local]
    if not closed:
        return baseline.select("product_id", "qty"), baseline_local
    rows = lake.table(LEDGER_CLOSES, closed[-1], closed[-1])
    return rows.select("product_id", F.col("on_hand_qty").alias("qty")), stock.close_of(closed[-1])


def ledger_stock(
    lake: Lake,
    baseline: DataFrame,
    as_of: date,
    lookback_days: int = K.STOCK_LOOKBACK_DAYS,
    baseline_local: datetime = K.LEDGER_BASELINE_LOCAL,
    pool: Iterable[int] = K.LEDGER_LOCATION_POOL,
    zone: str = K.LOCAL_ZONE,
) -> DataFrame:
    """Ledger stock from the last monthly close and the days since, however long the ledger is."""
    after = as_of + timedelta(days=1)
    opening, opened = _ledger_opening(lake, baseline, after, baseline_local)
    first_sale = as_of - timedelta(days=max(1, lookback_days) - 1)
    return stock.ledger_stock(
        opening,
        lake.table("fact_inventory_moves", opened.date() - timedelta(days=1), after),
        sales.combined_sales(
            lake.table("fact_sales", first_sale, as_of),
            lake.table("fact_invoice_sales", first_sale, as_of),
        ),
        lake.table("dim_products"),
        as_of,
        lookback_days=lookback_days,
        baseline_local=opened,
        pool=pool,
        zone=zone,
    )


def sell_through_report(lake: Lake, start: date, end: date) -> DataFrame:
    """Sell-through of a period; of the snapshots, only the two days it needs are opened."""
    stored = lake.days("fact_stock_on_hand_snapshot")
    days = [max((d for d in stored if d <= bound), default=None) for bound in (start, end)]
    path = lake.star("fact_stock_on_hand_snapshot")
    return sell_through.sell_through(
        lake.read(path, FACT_STOCK_SNAPSHOT, [day for day in days if day]),
        lake.table("agg_sales_daily_by_product", start, end),
        lake.table("dim_products"),
        start,
        end,
        stored,
    )


# --- chains ------------------------------------------------------------------------------------


def run_range(lake: Lake, start: date, end: date, zone: str = K.LOCAL_ZONE) -> None:
    """Everything from raw records to aggregates for the days of the range, published as one change.

    A run that is stopped at any step leaves the lake as it was.  Facts of the unknown day go through to its
    own aggregates.  Bills of the range that change costs of later stored days reach their
    snapshots, profit lines and profit aggregates too.
    """
    with lake.transaction():
        load_sales(lake, start, end, zone)
        load_invoices(lake, start, end)
        load_purchases(lake, start, end)
        load_moves(lake, start, end)
        load_quants(lake, start, end)
        ranges = [(start, end)]
        facts = ("fact_sales", "fact_invoice_sales", "fact_purchases")
        stored = any(K.UNKNOWN_DAY in lake.versions(lake.star(name)) for name in facts)
        if stored and not start <= K.UNKNOWN_DAY <= end:
            ranges.insert(0, (K.UNKNOWN_DAY, K.UNKNOWN_DAY))
        for first, last in ranges:
            update_sales_aggregates(lake, first, last)
            update_cost_events(lake, first, last)
            dirty = update_cost_snapshots(lake, first, last)
            update_profit_lines(lake, first, last)
            update_profit_aggregates(lake, first, last)
            update_dirty_profit(lake, dirty, last)


def catch_up(lake: Lake, as_of: date, zone: str = K.LOCAL_ZONE) -> tuple[date, date] | None:
    """Load the missing full days up to the day before ``as_of``; gaps inside are filled as well.

    A day is loaded when the table that the chain writes last has it.  Returns the first and the last day loaded.
    """
    have = {d for d in lake.days(LAST_TABLE) if d != K.UNKNOWN_DAY}
    if not have:
        return None
    first, last = min(have), as_of - timedelta(days=1)
    stored = lake.spark.createDataFrame([(day,) for day in sorted(have)], "date date")
    wanted = calendar(lake.spark, first, last) if first <= last else stored
    missing = sorted(row["date"] for row in refresh.days_to_load(wanted, stored, first, last).collect())
    if not missing:
        return None
    for first, last in _runs(missing):
        run_range(lake, first, last, zone)
    return missing[0], missing[-1]


def refresh_aggregate(
    lake: Lake, name: str, source: DataFrame, start: date | None = None, end: date | None = None
) -> None:
    """Refresh a stored daily aggregate from ``source``.

    With a range its days are replaced; otherwise the days after the last stored
    one are added, or everything is loaded when nothing is stored.  Days are
    replaced, never appended, so a repeated refresh does not double rows.
    """
    if start is None or end is None:
        stored = lake.table(name)
        newer = refresh.newer_than(source, stored)
        day = F.col("date").cast("date")
        bounds = newer.agg(F.min(day).alias("first"), F.max(day).alias("last")).first()
        if bounds["first"] is not None:
            lake.replace(name, newer, bounds["first"], bounds["last"])
    else:
        lake.replace(name, source, start, end)
