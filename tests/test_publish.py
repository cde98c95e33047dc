"""Published versions, stopped jobs, late bills, files of several types."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shelfledger.operators import costs
from shelfledger.plans import daily
from shelfledger.sources.lake import Lake, day_path, read_days, type_generations, write_days
from shelfledger.sources.manifest import CommitConflict
from shelfledger import schemas as S

D = [date(2025, 3, 1) + timedelta(days=k) for k in range(6)]
NAME = "agg_sales_daily"


def _daily(spark, rows):
    return spark.createDataFrame(
        [(day, revenue, 1, 1.0, 1) for day, revenue in rows],
        "date date, revenue double, transactions bigint, items_sold double, lines bigint",
    )


def _seen(lake, name=NAME, *columns):
    columns = columns or ("date", "revenue")
    return sorted((tuple(r) for r in lake.table(name).select(*columns).collect()), key=repr)


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "lake"))


def test_a_transaction_publishes_all_or_nothing(lake, spark):
    lake.replace(NAME, _daily(spark, [(D[0], 1.0), (D[1], 2.0)]), D[0], D[1])
    with pytest.raises(ZeroDivisionError), lake.transaction():
        lake.replace(NAME, _daily(spark, [(D[0], 9.0)]), D[0], D[2])
        assert _seen(lake) == [(D[0], 9.0)]  # its own writes
        assert _seen(Lake(spark, lake.root)) == [(D[0], 1.0), (D[1], 2.0)]  # others do not
        raise ZeroDivisionError
    assert _seen(lake) == [(D[0], 1.0), (D[1], 2.0)] and lake.days(NAME) == D[:2]
    with lake.transaction():
        lake.replace(NAME, _daily(spark, [(D[1], 5.0)]), D[1], D[2])
        lake.replace("agg_profit_daily", _daily(spark, []).select("date"), D[0], D[0])
    assert _seen(Lake(spark, lake.root)) == [(D[0], 1.0), (D[1], 5.0)]
    assert lake.days(NAME) == D[:3] and lake.days("agg_profit_daily") == D[:1]


def test_writers_of_the_same_day_conflict_and_others_do_not(lake, spark):
    other = Lake(spark, lake.root)
    lake.replace(NAME, _daily(spark, [(D[0], 1.0)]), D[0], D[0])
    with lake.transaction():
        lake.replace(NAME, _daily(spark, [(D[1], 2.0)]), D[1], D[1])
        other.replace(NAME, _daily(spark, [(D[2], 3.0)]), D[2], D[2])
    assert _seen(lake) == [(D[0], 1.0), (D[1], 2.0), (D[2], 3.0)]
    with pytest.raises(CommitConflict), lake.transaction():
        lake.replace(NAME, _daily(spark, [(D[2], 4.0)]), D[2], D[2])
        other.replace(NAME, _daily(spark, [(D[2], 5.0)]), D[2], D[2])
    assert _seen(lake) == [(D[0], 1.0), (D[1], 2.0), (D[2], 5.0)]


def test_vacuum_keeps_what_readers_need(lake, spark):
    for revenue in (1.0, 2.0, 3.0):
        lake.replace(NAME, _daily(spark, [(D[0], revenue)]), D[0], D[1])
    assert lake.vacuum(keep=1) == 0  # too young
    assert lake.vacuum(keep=1, older_than=-5.0) == 2
    assert _seen(lake) == _seen(Lake(spark, lake.root)) == [(D[0], 3.0)]
    assert read_days(spark, lake.star(NAME), S.AGG_SALES_DAILY).count() == 1


def test_plain_folders_are_read_and_taken_over(lake, spark):
    write_days(_daily(spark, [(D[0], 1.0), (D[1], 2.0)]), lake.star(NAME))
    assert _seen(lake) == [(D[0], 1.0), (D[1], 2.0)]
    lake.replace(NAME, _daily(spark, [(D[1], 7.0), (D[2], 3.0)]), D[1], D[2])
    assert _seen(lake) == _seen(Lake(spark, lake.root)) == [(D[0], 1.0), (D[1], 7.0), (D[2], 3.0)]


def test_files_of_differing_types(lake, spark):
    path = lake.star(NAME)
    texts = spark.createDataFrame([("7", "x")], "revenue string, lines string")
    for k in (0, 1):
        texts.write.parquet(day_path(path, D[k]))
    spark.createDataFrame([(5,)], "revenue bigint").write.parquet(day_path(path, D[2]))
    write_days(_daily(spark, [(D[3], 1.5), (D[4], 2.5)]), path)
    assert _seen(lake) == [(D[0], 7.0), (D[1], 7.0), (D[2], 5.0), (D[3], 1.5), (D[4], 2.5)]
    folders = [f"{day_path(path, day)}/*.parquet" for day in D[:5]]
    runs = type_generations(spark, path, folders, S.AGG_SALES_DAILY)
    assert [len(paths) for paths, _ in runs] == [2, 1, 2]
    assert lake.table(NAME, D[1], D[3]).count() == 3
    # written by the lake itself: the type stands in the manifest
    lake.replace(NAME, texts.withColumn("date", F.lit(D[5])), D[5], D[5])
    assert _seen(lake)[-1] == (D[5], 7.0)
    lake.replace(NAME, _daily(spark, [(D[0], 1.0)]), D[0], D[0])
    assert len(_seen(Lake(spark, lake.root))) == 6


def _brute_history(events, start, end):
    rows = []
    for p in sorted({e[1] for e in events}):
        for k in range((end - start).days + 1):
            day = start + timedelta(days=k)
            known = [e for e in events if e[1] == p and e[0] <= day]
            if known:
                best = max(known, key=lambda e: (e[0], e[3], e[2], e[4]))
                rows.append((day, p, best[2], best[3], best[4]))
    return sorted(rows)


def test_patched_history_equals_one_load(spark):
    rng = random.Random(5)
    first, last = date(2025, 1, 1), date(2025, 1, 30)

    def event(move):
        day = first + timedelta(days=rng.randrange(30))
        return (day, rng.randrange(8), float(rng.randrange(1, 5)), move, rng.choice([5, 7]))

    early = [event(k) for k in range(60)]
    dropped = [e for e in early if e[3] % 9 == 0]
    late = [event(100 + k) for k in range(12)]
    after = [e for e in early if e not in dropped] + late
    schema = "date date, product_id bigint, cost_unit_tax_in double, source_move_id bigint, source_tax_id bigint"
    before_df, after_df = (spark.createDataFrame(rows, schema) for rows in (early, after))
    ranges = costs.dirty_ranges(costs.changed_costs(before_df, after_df), after_df, last)
    stored = costs.cost_history(before_df, first, last)
    fresh = costs.cost_history_in(after_df, ranges)
    got = costs.patched(stored, fresh, costs.days_of(ranges)).select(*costs.COST_COLUMNS)
    assert sorted(map(tuple, got.collect())) == _brute_history(after, first, last)
    old, new = set(_brute_history(early, first, last)), set(_brute_history(after, first, last))
    changed = {(r[1], r[0]) for r in old ^ new}
    dirty = {tuple(r) for r in costs.days_of(ranges).collect()}
    assert changed <= dirty and len(dirty) <= len(changed) + 10


def _raw(spark, lake, bills):
    pos = [(f"{day} 04:00:00", k, f"P/{k}", k, 10 + k % 2, 1.0, 100.0) for k, day in enumerate(D * 2)]
    daily.save_raw(
        lake, "pos_order_lines",
        spark.createDataFrame(pos, "order_date string, order_id long, order_ref string, line_id long, product_id long, qty double, price_subtotal_incl double"),
        D[0], D[-1],
    )
    _bills(spark, lake, bills, D[0], D[-1])


def _bills(spark, lake, bills, start, end):
    rows = [(m, str(day), m, p, cost, 1.0, 5) for m, day, p, cost in bills if start <= day <= end]
    frame = spark.createDataFrame(
        rows, "move_id long, move_date string, move_line_id long, product_id long, price_unit double, quantity double, tax_id long"
    )
    daily.save_raw(lake, "account_move_in_invoice_lines", frame, start, end)


BILLS = [(1, D[0], 10, 10.0), (2, D[0], 11, 20.0), (3, D[3], 10, 30.0)]
LATE = (4, D[1], 10, 99.0)
CHAIN = ("fact_product_cost_events", "fact_product_cost_latest_daily", "fact_sales_lines_profit", "agg_profit_daily", "agg_profit_daily_by_product")


def test_a_late_bill_gives_the_lake_of_one_load(spark, lake, tmp_path, monkeypatch):
    whole = Lake(spark, str(tmp_path / "whole"))
    _raw(spark, whole, [*BILLS, LATE])
    daily.run_range(whole, D[0], D[4])
    _raw(spark, lake, BILLS)
    daily.run_range(lake, D[0], D[4])
    before = {name: lake.versions(lake.star(name)) for name in CHAIN}
    _bills(spark, lake, [*BILLS, LATE], D[1], D[1])
    read = []
    own = Lake.read
    monkeypatch.setattr(
        Lake, "read", lambda self, path, spec, days, pending=True: read.append((path, list(days))) or own(self, path, spec, read[-1][1], pending)
    )
    daily.run_range(lake, D[1], D[1])
    monkeypatch.undo()
    for name in CHAIN:
        columns = whole.table(name).columns
        assert _seen(lake, name, *columns) == _seen(whole, name, *columns), name
    snapshots = {(r[0], r[1]): r[2] for r in _seen(lake, CHAIN[1], "date", "product_id", "cost_unit_tax_in")}
    assert [snapshots[day, 10] for day in D[:5]] == [10.0, 99.0, 99.0, 30.0, 30.0]
    for name in CHAIN[1:]:  # the next purchase ends the change: nothing behind it is written
        after = lake.versions(lake.star(name))
        written = [day for day in after if after[day] != before[name][day]]
        assert sorted(written) == [D[1], D[2]], name
    events = [days for path, days in read if path.endswith(CHAIN[0])]
    assert events and all(min(days) >= D[1] for days in events if days)


def test_a_day_loaded_out_of_order_reaches_later_days(spark, lake, tmp_path):
    whole = Lake(spark, str(tmp_path / "whole"))
    _raw(spark, whole, [*BILLS, LATE])
    daily.run_range(whole, D[0], D[3])
    _raw(spark, lake, [*BILLS, LATE])
    for start, end in ((D[0], D[0]), (D[2], D[3]), (D[1], D[1])):
        daily.run_range(lake, start, end)
    for name in CHAIN:
        columns = whole.table(name).columns
        assert _seen(lake, name, *columns) == _seen(whole, name, *columns), name


def test_a_run_stopped_at_any_step_leaves_the_lake(spark, lake, monkeypatch):
    _raw(spark, lake, BILLS)
    daily.run_range(lake, D[0], D[1])
    state = {name: lake.versions(lake.star(name)) for name in S.DAILY_TABLES}
    for step in ("update_cost_snapshots", "update_dirty_profit"):
        with monkeypatch.context() as broken:
            broken.setattr(daily, step, lambda *a, **b: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                daily.run_range(lake, D[0], D[2])
        assert {name: Lake(spark, lake.root).versions(lake.star(name)) for name in state} == state


def test_status_of_the_layers_of_a_fact(spark, lake):
    _raw(spark, lake, BILLS)
    daily.load_purchases(lake, D[0], D[2])
    rows = [tuple(r) for r in daily.day_status(lake, "fact_purchases", D[0], D[4]).collect()]
    assert [r[1::2] for r in rows] == [("OK",) * 3, ("Empty",) * 3, ("Empty",) * 3, ("OK", "Missing", "Missing"), ("Empty", "Missing", "Missing")]
    assert [r[2::2] for r in rows] == [(2, 2, 2), (0, 0, 0), (0, 0, 0), (1, 0, 0), (0, 0, 0)]
    counts = lake.row_counts(lake.clean("account_move_in_invoice_lines"), D[0], D[4])
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert all("ReadSchema: struct<>" in line for line in plan.splitlines() if "FileScan" in line)
