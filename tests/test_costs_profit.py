"""Small frames with exact expectations: costs, line profit, aggregates."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shelfledger.operators import cleaning, costs, profit

DAY = date(2025, 3, 15)
PURCHASES = (
    "date date, move_id long, move_line_id long, product_id long, actual_price double,"
    " quantity double, tax_id long"
)
EVENTS = (
    "date date, product_id long, cost_unit_tax_in double, source_move_id long, source_tax_id long"
)
LEGACY = (
    "product_id long, cost_unit_tax_in double, source_tax_id long, effective_date date,"
    " cost_source string, priority int, is_active boolean"
)


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture
def purchases(spark):
    return spark.createDataFrame(
        [
            (DAY, 101, 1001, 1, 10.0, 5.0, 5),
            (DAY, 102, 1002, 2, 20.0, 3.0, 7),
            (DAY, 103, 1003, 1, 12.0, 2.0, 2),
            (DAY, 104, 1004, 3, -5.0, 1.0, 5),
        ],
        PURCHASES,
    )


def test_cost_events_apply_tax_and_skip_bonus_lines(purchases):
    rows = _rows(costs.cost_events(purchases), "source_move_id", "product_id", "cost_unit_tax_in")
    assert [(r[0], r[1]) for r in rows] == [(101, 1), (102, 2), (103, 1)]
    assert [r[2] for r in rows] == pytest.approx([10.0, 22.2, 12.0])


def test_cost_events_need_price_quantity_and_product(spark):
    bad = spark.createDataFrame(
        [
            (DAY, 101, 1, 1, 10.0, 5.0, 5),
            (DAY, 102, 2, 2, -5.0, 3.0, 5),
            (DAY, 103, 3, 3, 0.0, 2.0, 5),
            (DAY, 104, 4, 4, 8.0, 0.0, 5),
            (DAY, 105, 5, 0, 8.0, 1.0, 5),
            (DAY, 106, 6, None, 8.0, 1.0, 5),
        ],
        PURCHASES,
    )
    assert _rows(costs.cost_events(bad), "product_id") == [(1,)]


def test_latest_cost_is_the_last_document(purchases):
    latest = costs.latest_cost_by_product(costs.cost_events(purchases))
    assert _rows(latest, "product_id", "source_move_id") == [(1, 103), (2, 102)]


def test_line_profit_of_one_day(spark):
    pos = spark.createDataFrame(
        [
            (DAY, 501, 2001, 1, 2.0, 25.0, "POS/1"),
            (DAY, 502, 2002, 2, 1.0, 22.2, None),
            (DAY, 503, 2003, 4, 3.0, 60.0, "POS/3"),
            (DAY, 504, 2004, 1, 9.0, 99.0, "/"),
        ],
        "date date, order_id long, line_id long, product_id long, quantity double,"
        " revenue double, order_ref string",
    )
    invoices = spark.createDataFrame(
        [(DAY, 601, 3001, 1, 1.0, 15.0, 7, "INV/1"), (DAY, 602, 3002, 2, 2.0, 18.0, 5, "INV/2")],
        "date date, move_id long, move_line_id long, product_id long, quantity double,"
        " price_unit double, tax_id long, move_name string",
    )
    snapshot = spark.createDataFrame(
        [(1, 10.0, 5), (2, 20.0, 7), (4, 15.0, 5), (99, 50.0, 5)],
        "product_id long, cost_unit_tax_in double, source_tax_id long",
    )
    lines = profit.line_profit(profit.taxed_sales(pos, invoices), snapshot)
    rows = {r["line_id"]: r for r in lines.collect()}
    assert len(rows) == 5
    assert (rows[2001]["revenue_tax_in"], rows[2001]["cogs_tax_in"]) == (25.0, 20.0)
    assert rows[2001]["gross_profit"] == 5.0
    assert rows[3001]["revenue_tax_in"] == pytest.approx(16.65)
    assert (rows[3002]["revenue_tax_in"], rows[3002]["gross_profit"]) == (36.0, -4.0)


def test_unknown_cost_is_null_or_zero(spark):
    lines = spark.createDataFrame(
        [("pos", DAY, 1, 1, 7, 2.0, 30.0)],
        "channel string, date date, txn_id long, line_id long, product_id long,"
        " quantity double, revenue_tax_in double",
    )
    none = spark.createDataFrame([], "product_id long, cost_unit_tax_in double, source_tax_id long")
    row = profit.line_profit(lines, none).first()
    assert row["cogs_tax_in"] is None and row["gross_profit"] is None
    assert row["cost_unit_tax_in"] == 0.0 and row["cost_missing"]
    row = profit.line_profit(lines, none, zero_missing_cost=True).first()
    assert (row["cogs_tax_in"], row["gross_profit"]) == (0.0, 30.0)


def test_profit_aggregates(spark):
    lines = spark.createDataFrame(
        [
            (DAY, "pos", 1, 10, 1, 2.0, 25.0, 20.0, 5.0, False),
            (DAY, "pos", 2, 20, 2, 1.0, 22.2, 20.0, 2.2, False),
            (DAY, "pos", 2, 21, 2, 1.0, 11.1, 20.0, -8.9, False),
            (DAY, "pos", 3, 30, 1, 3.0, 45.0, 30.0, 15.0, False),
        ],
        "date date, channel string, txn_id long, line_id long, product_id long, quantity double,"
        " revenue_tax_in double, cogs_tax_in double, gross_profit double, cost_missing boolean",
    )
    day = profit.profit_daily(lines).first()
    assert day["revenue_tax_in"] == pytest.approx(103.3)
    assert day["cogs_tax_in"] == pytest.approx(90.0)
    assert day["gross_profit"] == pytest.approx(13.3)
    assert (day["transactions"], day["lines"]) == (3, 4)
    products = _rows(profit.profit_daily_by_product(lines), "product_id", "gross_profit")
    assert [p[0] for p in products] == [1, 2]
    assert [p[1] for p in products] == pytest.approx([20.0, -6.7])


def test_discounts_are_spread_over_a_bill(spark):
    bills = spark.createDataFrame(
        [
            (1, "2025-03-15", 1, 100.0, 2.0),
            (1, "2025-03-15", 2, 50.0, 2.0),
            (1, "2025-03-15", 3, -30.0, 1.0),
            (2, "2025-03-15", 4, 10.0, 1.0),
            (3, "bad", 5, -10.0, 1.0),
            (None, "2025-03-15", 6, 8.0, 1.0),
        ],
        "move_id long, move_date string, move_line_id long, price_unit double, quantity double",
    )
    rows = {r["move_line_id"]: r for r in cleaning.clean_bills(bills).collect()}
    prices = {key: row["actual_price"] for key, row in rows.items()}
    assert prices == pytest.approx({1: 90.0, 2: 45.0, 3: 0.0, 4: 10.0, 5: 0.0, 6: 8.0})
    assert rows[5]["date"] is None and rows[1]["tax_ids_json"] == "[]"


def _random_events(spark, seed, products=6, days=40, count=120):
    rng = random.Random(seed)
    rows = [
        (
            DAY + timedelta(days=rng.randrange(days)),
            rng.randrange(1, products + 1),
            float(rng.randrange(1, 50)),
            rng.randrange(1, 30),
            rng.choice([5, 7]),
        )
        for _ in range(count)
    ]
    return rows, spark.createDataFrame(rows, EVENTS)


def _newest(rows, product, day):
    found = [r for r in rows if r[1] == product and r[0] <= day]
    return max(found, key=lambda r: (r[0], r[3], r[2], r[4]), default=None)


@pytest.mark.parametrize("seed", [1, 2])
def test_history_equals_daily_snapshots(spark, seed):
    rows, events = _random_events(spark, seed)
    start, end = DAY + timedelta(days=10), DAY + timedelta(days=30)
    found = {
        (r["product_id"], r["date"]): (r["cost_unit_tax_in"], r["source_move_id"])
        for r in costs.cost_history(events, start, end).collect()
    }
    expected = {}
    for offset in range((end - start).days + 1):
        day = start + timedelta(days=offset)
        for product in {r[1] for r in rows}:
            newest = _newest(rows, product, day)
            if newest:
                expected[(product, day)] = (newest[2], newest[3])
    assert found == expected
    middle = start + timedelta(days=7)
    snapshot = costs.cost_snapshot(events, middle)
    assert {(r["product_id"], r["source_move_id"]) for r in snapshot.collect()} == {
        (p, move) for (p, day), (_, move) in expected.items() if day == middle
    }


@pytest.mark.parametrize("seed", [3, 4])
def test_as_of_costs_against_brute_force(spark, seed):
    rows, events = _random_events(spark, seed)
    rng = random.Random(seed + 100)
    legacy_rows = [
        (
            p,
            float(rng.randrange(1, 50)),
            5,
            DAY + timedelta(days=rng.randrange(30)),
            "old",
            rng.choice([2, 3]),
            p != 2,
        )
        for p in (1, 2, 3, 9)
        for _ in range(2)
    ]
    legacy = spark.createDataFrame(legacy_rows, LEGACY)
    asked = [(rng.randrange(1, 10), DAY + timedelta(days=rng.randrange(-2, 45))) for _ in range(80)]
    days = spark.createDataFrame(asked, "product_id long, date date")

    found = {
        (r["product_id"], r["date"]): r["source_move_id"]
        for r in costs.cost_as_of(events, days).collect()
    }
    expected = {key: _newest(rows, *key) for key in asked}
    assert found == {key: newest[3] for key, newest in expected.items() if newest}

    def best(product, day):
        offers = [(1, r[0], r[3], r[2]) for r in rows if r[1] == product and r[0] <= day]
        offers += [
            (r[5], r[3], 0, r[1]) for r in legacy_rows if r[0] == product and r[3] <= day and r[6]
        ]
        return max(offers, key=lambda o: (-o[0], o[1], o[2], o[3]), default=None)

    unified = {
        (r["product_id"], r["date"]): r["cost_unit_tax_in"]
        for r in costs.unified_cost_by_day(events, legacy, days).collect()
    }
    wanted = {key: best(*key) for key in asked}
    assert unified == {key: offer[3] for key, offer in wanted.items() if offer}


def test_later_purchase_does_not_hide_an_earlier_cost(spark):
    bought = spark.createDataFrame([(DAY, 1, 30.0, 5, 5)], EVENTS)
    legacy = spark.createDataFrame(
        [(1, 8.0, 5, DAY - timedelta(days=30), "old", 3, True)], LEGACY
    )
    before = costs.unified_cost(bought, legacy, DAY - timedelta(days=1)).first()
    assert (before["cost_unit_tax_in"], before["cost_source"]) == (8.0, "old")
    after = costs.unified_cost(bought, legacy, DAY).first()
    assert (after["cost_unit_tax_in"], after["cost_source"]) == (30.0, "latest_purchase")


def test_costs_never_go_negative_and_coverage_grows(spark):
    _, events = _random_events(spark, 5)
    covered = []
    for offset in (5, 15, 25, 39):
        snapshot = costs.cost_snapshot(events, DAY + timedelta(days=offset))
        assert snapshot.where(F.col("cost_unit_tax_in") < 0).isEmpty()
        covered.append(snapshot.count())
    assert covered == sorted(covered)


def test_opening_cost_fills_the_gap(spark):
    bought = spark.createDataFrame([(DAY, 1, 30.0, 5, 5), (DAY, 3, 0.0, 5, 5)], EVENTS)
    opening = spark.createDataFrame(
        [(1, 8.0, DAY, True), (2, 9.0, DAY, True), (3, 4.0, DAY, True), (4, 4.0, DAY, False)],
        "product_id long, cost_unit_tax_in double, effective_date date, is_active boolean",
    )
    found = costs.inventory_cost(bought, opening, DAY)
    assert _rows(found, "product_id", "cost_unit_tax_in") == [(1, 30.0), (2, 9.0), (3, 4.0)]
