"""Stored closes of the stock ledger, staged windows, snapshot days by folder index."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfledger import schemas as S
from shelfledger.operators import shaping, stock
from shelfledger.plans import daily
from shelfledger.sources.lake import Lake

START = datetime(2025, 1, 10, 7)
MOVES = "date timestamp_ntz, product_id bigint, location_src_id bigint, location_dest_id bigint, qty_moved double"


def _moves(rng, n, first=date(2025, 1, 5), days=120):
    rows = []
    for _ in range(n):
        at = datetime.combine(first, datetime.min.time()) + timedelta(hours=rng.randrange(24 * days))
        rows.append((at, rng.randrange(6), rng.choice([8, 1, None]), rng.choice([8, 2, None]), float(rng.randrange(1, 9))))
    return rows


@pytest.fixture
def opening(spark):
    return spark.createDataFrame([(1, 10.0), (2, None), (9, 4.0)], "product_id bigint, qty double")


def test_closes_equal_the_ledger_of_their_day(spark, opening):
    moves = spark.createDataFrame(_moves(random.Random(2), 400), MOVES)
    closes = [date(2025, 2, 1), date(2025, 3, 1), date(2025, 4, 1)]
    found = stock.ledger_closes(opening, moves, START, closes, [8])
    products = spark.createDataFrame([], "product_id bigint, product_name string, product_category string, product_brand string, product_barcode string, product_sku string")
    sales = spark.createDataFrame([], "product_id bigint, date date, quantity double")
    for day in closes:
        plain = stock.ledger_stock(opening, moves, sales, products, day, baseline_local=START, pool=[8])
        expected = {r["product_id"]: r["on_hand_qty"] for r in plain.collect()}
        got = {r["product_id"]: r["on_hand_qty"] for r in found.where(F.col("date") == F.lit(day)).collect()}
        assert got == expected and len(got) > 4


def test_the_lake_ledger_reads_one_close_and_the_days_since(spark, opening, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    rows = _moves(random.Random(3), 300)
    first, last, as_of = date(2025, 1, 1), date(2025, 5, 10), date(2025, 4, 20)
    lake.replace("fact_inventory_moves", spark.createDataFrame(rows, MOVES), first, last)
    plain = daily.ledger_stock(lake, opening, as_of, baseline_local=START, pool=[8])
    expected = sorted(map(str, plain.collect()))
    assert daily.update_ledger_closes(lake, opening, first, date(2025, 4, 25), START, [8]) == [date(2025, m, 1) for m in (2, 3, 4)]
    closed = daily.ledger_stock(lake, opening, as_of, baseline_local=START, pool=[8])
    assert sorted(map(str, closed.collect())) == expected
    read = {f.split("/fact_inventory_moves/")[1][:30] for f in closed.inputFiles() if "/fact_inventory_moves/" in f}
    assert read and min(read) >= "year=2025/month=03/day=31"
    # a move that arrives late for February reaches the closes of March and April
    late = [*rows, (datetime(2025, 2, 10, 3), 1, None, 8, 1000.0)]
    day = date(2025, 2, 10)
    lake.replace("fact_inventory_moves", spark.createDataFrame(late, MOVES), day, day)
    assert daily.update_ledger_closes(lake, opening, day, day, START, [8]) == [date(2025, m, 1) for m in (3, 4)]
    after = {r["product_id"]: r["on_hand_qty"] for r in daily.ledger_stock(lake, opening, as_of, baseline_local=START, pool=[8]).collect()}
    before = {r["product_id"]: r["on_hand_qty"] for r in plain.collect()}
    assert after[1] == before[1] + 1000.0


def test_a_window_keeps_the_whole_last_day(spark):
    moves = spark.createDataFrame(
        [(1, "2025-03-31 10:00:00"), (2, "2025-03-31"), (3, "2025-04-01"), (4, "2025-03-30 23:59:59"), (5, None)],
        "move_id int, move_date string",
    )
    found = shaping.of_days(moves, "move_date", date(2025, 3, 31), date(2025, 3, 31))
    assert sorted(r["move_id"] for r in found.collect()) == [1, 2]
    lines = spark.createDataFrame([(k % 5, k) for k in range(20)], "move_id int, line int")
    assert {r["move_id"] for r in shaping.of_headers(lines, found, "move_id").collect()} == {1, 2}


def test_sell_through_opens_two_snapshot_days(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    days = [date(2025, 3, k) for k in range(1, 11)]
    quants = spark.createDataFrame([(d, 1, float(d.day)) for d in days], "snapshot_date date, product_id bigint, quantity double")
    lake.replace("fact_stock_on_hand_snapshot", quants, days[0], days[-1], "snapshot_date")
    report = daily.sell_through_report(lake, days[2], days[6])
    row = report.first()
    assert row["begin_on_hand"] == 3.0 and row["units_received"] == 4.0
    assert len([f for f in report.inputFiles() if "snapshot" in f]) == 2
    assert S.DAILY_TABLES["fact_stock_ledger_close"]
