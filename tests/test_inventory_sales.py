"""Inventory, sales and quality operators on small frames."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfledger.operators import abc, actions, quality, refresh, sales, sell_through, stock

DAY = date(2025, 3, 15)
BY_PRODUCT = "date date, product_id long, revenue double, quantity double, lines long"
DAILY = "date date, revenue double, transactions long, items_sold double, lines long"
PRODUCTS = (
    "product_id long, product_name string, product_category string, product_parent_category string,"
    " product_brand string, product_barcode string, product_sku string"
)


@pytest.fixture
def products(spark):
    return spark.createDataFrame(
        [(i, f"P{i}", f"C{i % 2}", "Top", f"B{i % 3}", f"00AB{i}", f"S{i}") for i in range(1, 9)],
        PRODUCTS,
    )


def _rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- ABC -----------------------------------------------------------------------------------


@pytest.mark.parametrize("count, a, b", [(1, 0.2, 0.5), (7, 0.2, 0.5), (10, 0.0, 0.0), (6, 2.0, -1)])
def test_abc_cuts(spark, products, count, a, b):
    import math

    rows = [(DAY, i, float(100 - i), 1.0, 1) for i in range(1, count + 1)]
    items = abc.abc_classes(spark.createDataFrame(rows, BY_PRODUCT), products, DAY, DAY, a, b)
    a_cut = max(1, math.ceil(max(0, min(1, a)) * count))
    b_cut = max(a_cut, math.ceil(max(0, min(1, b)) * count))
    expected = ["A"] * a_cut + ["B"] * (b_cut - a_cut) + ["C"] * (count - b_cut)
    found = _rows(items.orderBy("sku_rank"), "product_id", "abc_class", "product_name")
    assert [r[1] for r in found] == expected
    assert [r[0] for r in found] == list(range(1, count + 1))
    assert found[0][2] == "P1"


def test_abc_ties_zero_revenue_and_swapped_dates(spark, products):
    rows = [(DAY, i, 0.0, 1.0, 1) for i in (5, 3, 4)]
    df = spark.createDataFrame(rows, BY_PRODUCT)
    items = abc.abc_classes(df, products, DAY, DAY - timedelta(days=3)).orderBy("sku_rank")
    assert [r[0] for r in _rows(items, "product_id")] == [3, 4, 5]
    assert {r for r in _rows(items, "revenue_share", "cumulative_share")} == {(0.0, 0.0)}
    assert abc.abc_classes(df.limit(0), products, DAY, DAY).count() == 0


# --- ledger --------------------------------------------------------------------------------


def test_ledger_against_brute_force(spark, products):
    rng = random.Random(7)
    pool = (44, 8)
    base = datetime(2025, 2, 10, 0)
    places = [44, 8, 5, 6, None]
    rows = [
        (
            base + timedelta(hours=rng.randrange(-48, 60 * 24)),
            rng.randrange(1, 6),
            rng.choice(places),
            rng.choice(places),
            float(rng.randrange(-9, 10)),
        )
        for _ in range(300)
    ]
    moves = spark.createDataFrame(
        rows,
        "date timestamp_ntz, product_id long, location_src_id long, location_dest_id long,"
        " qty_moved double",
    )
    opening = spark.createDataFrame([(1, 10.0), (7, 3.0)], "product_id long, qty double")
    as_of = date(2025, 3, 20)
    sold_rows = [(as_of - timedelta(days=d), p, 2.0) for d in (0, 29, 30) for p in (1, 6, 7)]
    sold = spark.createDataFrame(sold_rows, "date date, product_id long, quantity double")
    levels = stock.ledger_stock(opening, moves, sold, products, as_of, pool=pool)
    found = {r["product_id"]: r for r in levels.collect()}

    expected = {1: 10.0, 7: 3.0}
    for when, product, src, dest, qty in rows:
        # local 07:00 is midnight UTC
        if base < when <= datetime(2025, 3, 20, 0):
            change = 0.0
            if dest in pool and src not in pool:
                change = abs(qty)
            elif src in pool and dest not in pool:
                change = -abs(qty)
            expected[product] = expected.get(product, 0.0) + change
    assert {p: r["on_hand_qty"] for p, r in found.items()} == expected
    assert 6 not in found  # sold, but never stocked
    assert found[1]["units_sold"] == 4.0  # today and 29 days back
    assert found[7]["days_of_cover"] == pytest.approx(3.0 / (4.0 / 30))
    assert found[2]["days_of_cover"] is None and found[2]["units_sold"] == 0.0
    assert found[2]["dead_stock_flag"] == (found[2]["on_hand_qty"] > 0)


def test_no_ledger_before_the_opening_stock(spark, products):
    opening = spark.createDataFrame([(1, 10.0)], "product_id long, qty double")
    moves = spark.createDataFrame(
        [],
        "date timestamp_ntz, product_id long, location_src_id long, location_dest_id long,"
        " qty_moved double",
    )
    sold = spark.createDataFrame([], "date date, product_id long, quantity double")
    early = stock.ledger_stock(opening, moves, sold, products, date(2025, 2, 9))
    first = stock.ledger_stock(opening, moves, sold, products, date(2025, 2, 10))
    assert early.columns == first.columns
    assert (early.count(), first.count()) == (0, 1)


ITEMS = (
    "product_id long, product_name string, on_hand_qty double, days_of_cover double,"
    " low_stock_flag boolean, dead_stock_flag boolean"
)


def test_cover_histogram_bins(spark):
    rows = [(i, "n", 1.0, float(i), False, False) for i in range(0, 41)] + [
        (99, "n", 1.0, None, False, True)
    ]
    bins = stock.cover_histogram(spark.createDataFrame(rows, ITEMS), 4).collect()
    assert [(b["cover_from"], b["sku_count"]) for b in bins] == [
        (0.0, 10),
        (10.0, 10),
        (20.0, 10),
        (30.0, 11),
    ]
    same = [(i, "n", 1.0, 5.0, False, False) for i in range(3)]
    bins = stock.cover_histogram(spark.createDataFrame(same, ITEMS), 4).collect()
    assert [b["sku_count"] for b in bins] == [3, 0, 0, 0]


def test_quick_filters(spark):
    items = spark.createDataFrame(
        [
            (1, "a", 5.0, 2.0, True, False),
            (2, "b", 5.0, None, False, True),
            (3, "c", 5.0, 20.0, False, False),
            (4, "d", 0.0, None, False, False),
        ],
        ITEMS,
    )
    found = {
        name: [r[0] for r in _rows(stock.quick_filter(items, name).orderBy("product_id"), "product_id")]
        for name in stock.QUICK_FILTERS
    }
    assert found == {"all": [1, 2, 3, 4], "low": [1], "dead": [2], "healthy": [3]}
    with pytest.raises(ValueError):
        stock.quick_filter(items, "odd")


# --- status, sell-through --------------------------------------------------------------------


def test_stock_status_order(spark):
    snapshots = spark.createDataFrame(
        [(DAY, 1, 10.0), (DAY, 2, 10.0), (DAY, 3, 1000.0), (DAY, 4, 50.0), (DAY, 5, 0.0)],
        "snapshot_date date, product_id long, quantity double",
    )
    sold = spark.createDataFrame(
        [(DAY, p, 60.0, 30.0, 1) for p in (2, 3, 4, 5, 6)], BY_PRODUCT
    )
    rows = {r["product_id"]: r for r in stock.stock_status(snapshots, sold, DAY).collect()}
    assert {p: r["stock_status"] for p, r in rows.items()} == {
        1: "dead_stock",
        2: "low_stock",
        3: "overstock",
        4: "healthy",
        5: "dead_stock",
    }
    assert rows[3]["est_stock_value"] == 2000.0 and rows[1]["days_of_cover"] == 999999.0


def test_sell_through_uses_the_latest_snapshots(spark, products):
    days = [DAY - timedelta(days=d) for d in (20, 12, 2)]
    snapshots = spark.createDataFrame(
        [(days[0], 1, 999.0), (days[1], 1, 10.0), (days[2], 1, 4.0), (days[2], 2, 5.0)],
        "snapshot_date date, product_id long, quantity double",
    )
    sold = spark.createDataFrame(
        [(DAY, 1, 1.0, 8.0, 1), (DAY, 3, 1.0, 2.0, 1), (DAY - timedelta(days=11), 1, 1.0, 50.0, 1)],
        BY_PRODUCT,
    )
    items = sell_through.sell_through(snapshots, sold, products, DAY - timedelta(days=10), DAY)
    rows = {r["product_id"]: r for r in items.collect()}
    assert (rows[1]["begin_on_hand"], rows[1]["units_received"]) == (10.0, 2.0)
    assert rows[1]["sell_through"] == pytest.approx(8 / 12)
    assert (rows[2]["units_received"], rows[2]["sell_through"]) == (5.0, 0.0)
    assert (rows[3]["units_received"], rows[3]["sell_through"]) == (2.0, 1.0)
    total = sell_through.sell_through_rollup(items).where("level = 'total'").first()
    assert total["sell_through"] == pytest.approx(10 / 19)


# --- action lists -----------------------------------------------------------------------------


def test_action_lists(spark):
    stock_rows = [
        (1, 5.0, 1.0, 5.0, True, False),  # A, runs out
        (2, 0.0, 2.0, 0.0, True, False),  # B, sold out with demand
        (3, 900.0, 1.0, 900.0, False, False),  # no class -> C, too much
        (4, 7.0, 0.0, None, False, True),  # C, does not sell
        (5, 100.0, 2.0, 50.0, False, False),  # A, fine
        (6, -1.0, 0.0, None, False, False),  # B without demand
    ]
    items = spark.createDataFrame(
        stock_rows,
        "product_id long, on_hand_qty double, avg_daily_sold double, days_of_cover double,"
        " low_stock_flag boolean, dead_stock_flag boolean",
    )
    classes = spark.createDataFrame(
        [(1, "A", 50.0), (2, "B", 40.0), (4, "C", 1.0), (5, "A", 90.0), (6, "B", 3.0)],
        "product_id long, abc_class string, revenue double",
    )
    unit_costs = spark.createDataFrame(
        [(3, 2.0), (5, 1.0)], "product_id long, cost_unit_tax_in double"
    )
    position = actions.stock_position(items, classes, unit_costs)
    assert [r[0] for r in _rows(actions.reorder_list(position), "product_id")] == [2, 1]
    assert [r[0] for r in _rows(actions.markdown_list(position), "product_id")] == [3, 4]
    assert [r[0] for r in _rows(actions.top_performers(position), "product_id")] == [5]
    wanted = dict(_rows(position, "product_id", "reorder_qty"))
    assert (wanted[1], wanted[2], wanted[3], wanted[6]) == (25, 60, 0, 1)
    summary = actions.action_summary(position).first()
    assert summary["attention_count"] == 4 and summary["healthy_count"] == 1
    assert (summary["revenue_at_risk"], summary["capital_locked"]) == (90.0, 1800.0)
    assert (summary["overstock_value"], summary["overstock_sku_count"]) == (1800.0, 1)
    assert (summary["total_inventory_value"], summary["total_sku_count"]) == (1900.0, 6)


def test_filters(spark, products):
    purchases = spark.createDataFrame(
        [(7, 1), (7, 2), (8, 3), (7, 0)], "vendor_id long, product_id long"
    )

    def ids(**kwargs):
        found = actions.apply_filters(products, purchases=purchases, **kwargs)
        return sorted(r[0] for r in _rows(found, "product_id"))

    assert ids() == list(range(1, 9))
    assert ids(categories=["C1"]) == [1, 3, 5, 7]
    assert ids(categories=["C1"], brands=["B0"]) == [3]
    assert ids(barcode=" ab4 ") == [4]
    assert ids(barcode="a.4") == []
    assert ids(vendor_ids=[7]) == [1, 2]
    assert ids(vendor_ids=[99]) == []


# --- sales reports -----------------------------------------------------------------------------


def test_trend_fills_gaps_and_keeps_whole_buckets(spark):
    daily = spark.createDataFrame(
        [
            (date(2024, 12, 31), 5.0, 1, 1.0, 1),  # same week as the start, before it
            (date(2025, 1, 2), 10.0, 4, 3.0, 4),
            (date(2025, 1, 14), 2.0, 0, 1.0, 1),
        ],
        DAILY,
    )
    rows = sales.sales_trend(daily, date(2025, 1, 1), date(2025, 1, 13), "weekly").collect()
    assert [(r["date"], r["revenue"]) for r in rows] == [
        (date(2024, 12, 30), 15.0),
        (date(2025, 1, 6), 0.0),
        (date(2025, 1, 13), 2.0),
    ]
    assert [r["avg_transaction_value"] for r in rows] == [3.0, 0.0, 0.0]
    swapped = sales.sales_trend(daily, date(2025, 1, 3), date(2025, 1, 1)).collect()
    assert [r["revenue"] for r in swapped] == [0.0, 10.0, 0.0]


def test_comparison_with_nothing_before(spark):
    daily = spark.createDataFrame([(DAY, 10.0, 4, 3.0, 4)], DAILY)
    row = sales.revenue_comparison(daily, DAY, DAY).first()
    assert (row["cur_revenue"], row["prev_revenue"], row["revenue_pct"]) == (10.0, 0.0, 0.0)
    empty = sales.revenue_comparison(daily.limit(0), DAY, DAY).first()
    assert (empty["cur_revenue"], empty["cur_avg_transaction_value"]) == (0.0, 0.0)


def test_orders_and_invoices_with_one_id_are_two_transactions(spark):
    lines = spark.createDataFrame(
        [("pos", DAY, 1, 1.0, 1.0), ("invoice", DAY, 1, 1.0, 1.0), ("pos", DAY, 1, 1.0, 1.0)],
        "channel string, date date, txn_id long, revenue double, quantity double",
    )
    assert sales.sales_daily(lines).first()["transactions"] == 2


def test_principals_without_a_name_are_left_out(spark):
    names = [" Tea ", "-", "", None, "None", "null", " x ", "Unknown", "Unknown Principal"]
    df = spark.createDataFrame(
        [(n, float(i)) for i, n in enumerate(names)], "principal string, revenue double"
    )
    found = [r[0] for r in _rows(sales.named_principals(df), "principal")]
    assert found == ["Unknown", " Tea "]


# --- quality -------------------------------------------------------------------------------------


def test_validator(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    results = {
        (r["rule"], r["subject"]): r["passed"]
        for r in quality.validate(df, expected=["a", "c"], not_null=["a", "b"], min_rows=3).collect()
    }
    assert results == {
        ("schema", "a"): True,
        ("schema", "c"): False,
        ("schema", "b"): True,
        ("no_nulls", "a"): True,
        ("no_nulls", "b"): False,
        ("min_rows", "3"): False,
    }


def test_missing_ranges_merge_consecutive_days(spark):
    present = [DAY + timedelta(days=d) for d in (0, 1, 4, 9)]
    df = spark.createDataFrame([(d,) for d in present], "date date")
    found = _rows(
        quality.missing_ranges(df, DAY, DAY + timedelta(days=10)), "start_date", "end_date", "days"
    )
    assert found == [
        (DAY + timedelta(days=2), DAY + timedelta(days=3), 2),
        (DAY + timedelta(days=5), DAY + timedelta(days=8), 4),
        (DAY + timedelta(days=10), DAY + timedelta(days=10), 1),
    ]
    assert quality.missing_ranges(df, DAY, DAY + timedelta(days=1)).count() == 0


@pytest.mark.parametrize(
    "source, derived, status",
    [
        ((0, 1), (0, 1), "SYNCED"),
        ((0, 1), (0,), "STALE"),
        ((0,), (0, 1), "ORPHANED"),
        ((0, 1), (1, 2), "MIXED"),
        ((0, 1), None, "MISSING"),
    ],
)
def test_sync_status(spark, source, derived, status):
    def days(offsets):
        return spark.createDataFrame([(DAY + timedelta(days=o),) for o in offsets], "date date")

    other = None if derived is None else days(derived)
    row = quality.sync_status(days(source), other, DAY, DAY + timedelta(days=5)).first()
    assert row["status"] == status


def test_days_behind(spark):
    df = spark.createDataFrame([(DAY,)], "date date")
    assert quality.days_behind(df, DAY + timedelta(days=1)).first()["status"] == "healthy"
    late = quality.days_behind(df, DAY + timedelta(days=3)).first()
    assert (late["days_behind"], late["status"]) == (3, "unhealthy")
    assert quality.days_behind(df.limit(0), DAY).first()["status"] == "unknown"


def test_refresh_strategy(spark):
    df = spark.createDataFrame([(DAY,)], "date date")
    assert tuple(refresh.refresh_strategy(df).first()) == ("incremental", DAY)
    assert tuple(refresh.refresh_strategy(df.limit(0)).first()) == ("full", None)


def test_wrong_daily_totals_are_found(spark):
    lines = spark.createDataFrame(
        [(DAY, 10.0, 4.0, 6.0, 1.0), (DAY + timedelta(days=1), 5.0, None, None, 1.0)],
        "date date, revenue_tax_in double, cogs_tax_in double, gross_profit double, quantity double",
    )
    daily = spark.createDataFrame(
        [(DAY, 10.0, 4.0, 7.0, 1.0, 1), (DAY + timedelta(days=1), 5.0, None, None, 1.0, 1)],
        "date date, revenue_tax_in double, cogs_tax_in double, gross_profit double,"
        " quantity double, lines long",
    )
    found = dict(_rows(quality.daily_total_checks(lines, daily), "date", "mismatch"))
    assert found == {DAY: True, DAY + timedelta(days=1): False}
    checks = quality.profit_line_checks(lines.withColumn("cost_unit_tax_in", F.lit(4.0)))
    assert dict(_rows(checks, "date", "status")) == {
        DAY: "VALID",
        DAY + timedelta(days=1): "INVALID",
    }
