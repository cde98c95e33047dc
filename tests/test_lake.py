"""Day partitions, typed views, CSV files and the range jobs."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfledger import constants as K
from shelfledger import schemas as S
from shelfledger.operators import costs, quality, sales
from shelfledger.plans import daily
from shelfledger.sources import files
from shelfledger.sources.lake import (
    Lake,
    day_files,
    day_path,
    read_days,
    read_or_empty,
    replace_days,
    write_days,
)

D1, D2, D3 = date(2025, 3, 14), date(2025, 3, 15), date(2025, 3, 16)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "table")


def _daily(spark, rows):
    return spark.createDataFrame(
        rows, "date date, revenue double, transactions bigint, items_sold double, lines bigint"
    )


def test_missing_table_is_empty_with_schema(spark, folder):
    df = read_or_empty(spark, folder, S.AGG_SALES_DAILY)
    assert df.columns == S.column_names(S.AGG_SALES_DAILY)
    assert df.count() == 0


def test_day_folders_are_padded(spark, folder):
    write_days(_daily(spark, [(D2, 1.0, 1, 1.0, 1)]), folder)
    assert day_path(folder, D2).endswith("year=2025/month=03/day=15")
    assert spark.read.parquet(day_path(folder, D2)).count() == 1


def test_rerun_replaces_only_its_days(spark, folder):
    write_days(_daily(spark, [(D1, 1.0, 1, 1.0, 1), (D2, 2.0, 1, 1.0, 1)]), folder)
    write_days(_daily(spark, [(D2, 5.0, 1, 1.0, 1)]), folder)
    write_days(_daily(spark, [(D2, 5.0, 1, 1.0, 1)]), folder)
    rows = read_days(spark, folder, S.AGG_SALES_DAILY).orderBy("date").collect()
    assert [(r["date"], r["revenue"]) for r in rows] == [(D1, 1.0), (D2, 5.0)]


def test_replace_days_empties_days_without_rows(spark, folder):
    first = _daily(spark, [(D1, 1.0, 1, 1.0, 1), (D2, 2.0, 1, 1.0, 1), (D3, 3.0, 1, 1.0, 1)])
    replace_days(first, folder, D1, D3)
    replace_days(first.where(F.col("date") == F.lit(D1)), folder, D1, D2)
    rows = read_days(spark, folder, S.AGG_SALES_DAILY).orderBy("date").collect()
    assert [r["date"] for r in rows] == [D1, D3]
    status = quality.coverage(
        {"t": read_days(spark, folder, S.AGG_SALES_DAILY)},
        D1,
        D3 + timedelta(days=1),
        files={"t": day_files(spark, folder)},
    ).collect()
    assert [r["status"] for r in status] == ["OK", "Empty", "OK", "Missing"]


def test_single_empty_day_leaves_an_empty_file(spark, folder):
    replace_days(_daily(spark, []), folder, D2, D2)
    assert {r["date"] for r in day_files(spark, folder).collect()} == {D2}
    assert read_days(spark, folder, S.AGG_SALES_DAILY).count() == 0


def test_only_folders_of_the_range_are_read(spark, folder):
    write_days(
        _daily(spark, [(D1 + timedelta(days=i), float(i), 1, 1.0, 1) for i in range(40)]), folder
    )
    df = read_days(spark, folder, S.AGG_SALES_DAILY, D2, D3)
    assert df.count() == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "make_date" in filters
    assert len(df.inputFiles()) >= 2


def test_report_filters_prune_folders(spark, tmp_path, folder):
    write_days(
        _daily(spark, [(D1 + timedelta(days=i), float(i), 1, 1.0, 1) for i in range(40)]), folder
    )
    report = sales.revenue_comparison(read_days(spark, folder, S.AGG_SALES_DAILY), D3, D3)
    assert report.first()["cur_revenue"] == 2.0
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "make_date" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_date_comes_from_folders_when_the_column_is_missing(spark, folder):
    df = _daily(spark, [(D2, 7.0, 2, 1.0, 1)]).withColumn("when", F.col("date")).drop("date")
    write_days(df, folder, "when")
    row = read_days(spark, folder, S.AGG_SALES_DAILY).first()
    assert row["date"] == D2 and row["revenue"] == 7.0


def test_typed_view_casts_and_fills_across_file_schemas(spark, folder):
    spark.createDataFrame([("12", "bad")], "order_id string, quantity string").write.parquet(
        folder + "/year=2025/month=03/day=15"
    )
    df = read_days(spark, folder, S.FACT_SALES, merge_schema=True)
    row = df.first()
    assert row["order_id"] == 12 and row["quantity"] == 0.0 and row["order_ref"] == ""
    assert row["date"] == datetime(2025, 3, 15)


def test_beginning_costs_file(spark, tmp_path):
    path = tmp_path / "costs.csv"
    path.write_text(
        "product_id,cost_unit,purchase_tax_id,notes\n"
        "12345,15000.00,5,first\n67890,25000.00,2,\n11111,8500.50,7,third\n22222,12000.00,5,last\n"
    )
    rows = {r["product_id"]: r for r in files.read_beginning_costs(spark, str(path)).collect()}
    assert len(rows) == 4
    assert rows[11111]["cost_unit_tax_in"] == pytest.approx(8500.50 * 1.11)
    assert rows[12345]["effective_date"] == date(2025, 2, 10) and rows[67890]["notes"] == ""


@pytest.mark.parametrize(
    "text, message",
    [
        ("product_id,cost_unit\n1,2\n", "missing columns"),
        ("product_id,cost_unit,purchase_tax_id\n0,2,5\n", "product_id"),
        ("product_id,cost_unit,purchase_tax_id\nx,2,5\n", "product_id"),
        ("product_id,cost_unit,purchase_tax_id\n1,-2,5\n", "negative cost_unit"),
    ],
)
def test_bad_beginning_costs_are_fatal(spark, tmp_path, text, message):
    path = tmp_path / "costs.csv"
    path.write_text(text)
    with pytest.raises(ValueError, match=message):
        files.read_beginning_costs(spark, str(path))


def test_ledger_baseline_file(spark, tmp_path):
    path = tmp_path / "stock.csv"
    path.write_text(
        '"Product/ID,ID,Name,Qty"\n'
        '"a,10,""Tea, green"",5"\n'
        '"b,10,Tea,2.5",x,y\n'
        '"c,bad,Cup,9"\n'
        '"d,11,Cup,n/a"\n'
    )
    rows = files.read_ledger_baseline(spark, str(path)).collect()
    assert sorted((r["product_id"], r["qty"]) for r in rows) == [(10, 7.5), (11, 0.0)]


def test_beginning_costs_reach_the_lake(spark, tmp_path):
    path = tmp_path / "costs.csv"
    path.write_text("product_id,cost_unit,purchase_tax_id\n5,10,7\n")
    lake = Lake(spark, str(tmp_path / "lake"))
    assert lake.table("fact_product_beginning_costs").count() == 0
    for _ in range(2):
        daily.load_beginning_costs(lake, str(path))
    rows = lake.table("fact_product_beginning_costs").collect()
    assert [(r["product_id"], r["is_active"]) for r in rows] == [(5, True)]
    assert rows[0]["cost_unit_tax_in"] == pytest.approx(11.1)


def test_hot_day_is_written_by_several_tasks_in_product_order(spark, folder):
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = spark.range(0, 100_000, 1, 8).select(
            F.when(F.col("id") % 3 > 0, F.lit(D1)).otherwise(
                F.date_add(F.lit(D2), (F.col("id") % 7).cast("int"))
            ).alias("date"),
            (F.col("id") * 7919 % 1000).alias("product_id"),
            F.rand(3).alias("revenue"),
        )
        write_days(df, folder, sort_by=("product_id",))
    finally:
        for key in settings:
            spark.conf.unset(key)
    hot = spark.read.parquet(day_path(folder, D1))
    assert len(hot.inputFiles()) > 1
    assert spark.read.parquet(folder).count() == 100_000
    one = spark.read.parquet(hot.inputFiles()[0]).select("product_id").collect()
    assert one == sorted(one)


def test_exports(spark, tmp_path):
    df = _daily(spark, [(D1, 1.0, 1, 1.0, 1), (D2, 2.0, 1, 1.0, 1)]).orderBy("date")
    files.export_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 2 and back.columns == df.columns
    files.export_parquet(df, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2


# --- range jobs --------------------------------------------------------------------------


@pytest.fixture
def lake(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    pos = spark.createDataFrame(
        [
            ("2025-03-14 18:00:00", 1, "POS/1", 11, 10, 2.0, 5000.0, 500.0),  # local 15th
            ("2025-03-15 01:00:00", 2, "POS/2", 21, 20, 1.0, 100.0, None),
            ("2025-03-15 02:00:00", 3, "/", 31, 20, 1.0, 900.0, None),
            ("2025-03-15 20:00:00", 4, None, 41, 10, 1.0, 50.0, 0.0),  # local 16th
        ],
        "order_date string, order_id long, order_ref string, line_id long, product_id long,"
        " qty double, price_subtotal_incl double, discount_amount double",
    )
    bills = spark.createDataFrame(
        [
            (100, "2025-03-14", 1, 10, 10.0, 4.0, 7),
            (100, "2025-03-14", 2, 10, -4.0, 1.0, 7),
            (101, "2025-03-16", 3, 10, 20.0, 1.0, 5),
        ],
        "move_id long, move_date string, move_line_id long, product_id long, price_unit double,"
        " quantity double, tax_id long",
    )
    invoices = spark.createDataFrame(
        [(1, "INV/1", "2025-03-15", 7, 20, 15.0, 2.0, 7)],
        "move_id long, move_name string, move_date string, move_line_id long, product_id long,"
        " price_unit double, quantity double, tax_id long",
    )
    moves = spark.createDataFrame(
        [(5, 1, "2025-03-15 03:00:00", 10, 8, 44, 3.0)],
        "move_id long, move_line_id long, movement_date string, product_id long,"
        " location_src_id long, location_dest_id long, qty_moved double",
    )
    quants = spark.createDataFrame(
        [(1, "2025-03-15", 10, 4.0)],
        "quant_id long, snapshot_date string, product_id long, quantity double",
    )
    for name, df in {
        "pos_order_lines": pos,
        "account_move_in_invoice_lines": bills,
        "account_move_out_invoice_lines": invoices,
        "inventory_moves": moves,
        "stock_quants": quants,
    }.items():
        daily.save_raw(lake, name, df, D1, D3)
    products = spark.createDataFrame(
        [(10, "Tea", "Drinks", "Food", "Leaf"), (20, "Cup", "Ware", "Home", None)],
        "product_id long, product_name string, product_category string,"
        " product_parent_category string, product_brand string",
    )
    daily.load_dimension(lake, "dim_products", products)
    return lake


def _rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_range_job_builds_the_lake(lake):
    daily.run_range(lake, D1, D3)
    assert _rows(lake.table("fact_sales"), "order_id", F.to_date("date"), "revenue") == [
        (1, D2, 4500.0),
        (2, D2, 100.0),
        (3, D2, 900.0),
        (4, D3, 50.0),
    ]
    snapshots = lake.table("fact_product_cost_latest_daily")
    expected = 10.0 * (1 - 4.0 / 40.0) * 1.11
    found = {(r["date"], r["product_id"]): r["cost_unit_tax_in"] for r in snapshots.collect()}
    assert found[(D1, 10)] == pytest.approx(expected)
    assert found[(D2, 10)] == pytest.approx(expected)
    assert found[(D3, 10)] == pytest.approx(20.0)
    assert len(found) == 3
    day = lake.table("agg_sales_daily", D2, D2).first()
    assert (day["revenue"], day["transactions"], day["lines"]) == (4630.0, 3, 3)
    profit_day = lake.table("agg_profit_daily", D2, D2).first()
    assert profit_day["gross_profit"] == pytest.approx(4500 - 2 * expected)
    assert profit_day["revenue_tax_in"] == pytest.approx(4600 + 33.3)
    brands = _rows(lake.table("agg_sales_daily_by_principal", D2, D2), "principal", "revenue")
    assert brands == [("Leaf", 4500.0), ("Unknown", 130.0)]
    moved = lake.table("fact_inventory_moves").first()
    assert moved["product_name"] == "Tea" and moved["date"] == datetime(2025, 3, 15, 3)
    assert lake.table("fact_stock_on_hand_snapshot").count() == 1


def test_rerunning_one_day_changes_nothing(lake):
    daily.run_range(lake, D1, D3)
    tables = [name for name in S.DAILY_TABLES if name != "fact_inventory_moves"]
    whole = {name: _rows(lake.table(name), *lake.table(name).columns) for name in tables}
    daily.run_range(lake, D2, D2)  # has a snapshot of the day before, so it goes by increment
    for name in tables:
        assert _rows(lake.table(name), *lake.table(name).columns) == whole[name], name


def test_catch_up_loads_the_missing_days(lake):
    daily.run_range(lake, D1, D2)
    assert daily.catch_up(lake, D3 + timedelta(days=1)) == (D3, D3)
    assert lake.table("agg_sales_daily", D3, D3).first()["revenue"] == 50.0
    assert daily.catch_up(lake, D3 + timedelta(days=1)) is None


def test_refresh_aggregate_is_idempotent(lake):
    daily.run_range(lake, D1, D2)
    daily.load_sales(lake, D1, D3)
    daily.load_invoices(lake, D1, D3)
    source = sales.sales_daily(
        sales.combined_sales(lake.table("fact_sales"), lake.table("fact_invoice_sales"))
    )
    for _ in range(2):
        daily.refresh_aggregate(lake, "agg_sales_daily", source)
    assert _rows(lake.table("agg_sales_daily"), "date", "revenue") == [(D2, 4630.0), (D3, 50.0)]
    daily.refresh_aggregate(lake, "agg_sales_daily", source, D1, D3)
    assert lake.table("agg_sales_daily").count() == 2


def test_views_for_sql(lake, spark):
    daily.run_range(lake, D1, D3)
    lake.register_views()
    total = spark.sql(
        "SELECT sum(revenue) FROM fact_sales_all s LEFT JOIN dim_products p USING (product_id)"
        " WHERE p.product_category = 'Drinks'"
    ).first()[0]
    assert total == 4550.0
    cost = spark.sql("SELECT * FROM fact_product_costs_unified").collect()
    assert [(r["product_id"], r["cost_source"]) for r in cost] == [(10, "latest_purchase")]
    assert spark.sql("SELECT max(movement_date) FROM fact_inventory_moves").first()[0]


def test_incremental_snapshot_equals_full(lake):
    daily.run_range(lake, D1, D3)
    events = lake.table("fact_product_cost_events")
    full = costs.cost_snapshot(events, D3)
    step = costs.cost_snapshot_next(
        costs.cost_snapshot(events, D2), events.where(F.col("date") == F.lit(D3)), D3
    )
    assert _rows(full, *full.columns) == _rows(step, *full.columns)


def test_records_outside_the_range_are_an_error(lake, spark):
    row = spark.createDataFrame([(9, "2025-04-01", 10, 4.0)], "quant_id long, snapshot_date string, product_id long, quantity double")
    with pytest.raises(ValueError, match="1 records"):
        daily.save_raw(lake, "stock_quants", row, D1, D3)


def _bad_dates(spark):
    return spark.createDataFrame(
        [("2025-03-15 xx", 50, "A", 51, 10, 1.0, 7.0, 0.0), ("soon", 60, "B", 61, 10, 1.0, 8.0, 0.0), (None, 70, "C", 71, 10, 1.0, 9.0, 0.0)],
        "order_date string, order_id long, order_ref string, line_id long, product_id long,"
        " qty double, price_subtotal_incl double, discount_amount double",
    )


def test_unreadable_dates_reach_the_facts_on_their_folder_day(lake, spark):
    for start in (D2, D2 - timedelta(days=1)):  # overlapping ranges store no record twice
        daily.save_raw(lake, "pos_order_lines", _bad_dates(spark), start, D2)
    unknown = lake.read(lake.raw("pos_order_lines"), S.RAW_POS_LINES, [K.UNKNOWN_DAY])
    assert sorted(r["order_id"] for r in unknown.collect()) == [60, 70]
    daily.run_range(lake, D1, D3)
    found = _rows(lake.table("fact_sales").where("order_id >= 50"), "order_id", F.to_date("date"))
    assert found == [(50, D2), (60, K.UNKNOWN_DAY), (70, K.UNKNOWN_DAY)]
    for name, column in (("agg_sales_daily", "revenue"), ("agg_profit_daily", "revenue_tax_in")):
        assert lake.table(name, K.UNKNOWN_DAY, K.UNKNOWN_DAY).first()[column] == 17.0


def test_a_range_gives_the_same_lake_as_its_days(lake, spark, tmp_path):
    import shutil

    daily.save_raw(lake, "account_move_out_invoice_lines", spark.createDataFrame([], "move_id long, move_date string"), D3, D3)
    other = Lake(spark, str(tmp_path / "other"))
    shutil.copytree(lake.root, other.root)
    daily.run_range(lake, D1, D3)
    tables = list(S.DAILY_TABLES)
    tables = [name for name in tables if lake.days(name)]
    whole = {name: (_rows(lake.table(name), *lake.table(name).columns), lake.days(name)) for name in tables}
    for day in (D1, D2, D3):
        daily.run_range(other, day, day)
    for name in tables:
        assert _rows(other.table(name), *other.table(name).columns) == whole[name][0], name
        assert other.days(name) == whole[name][1] == [D1, D2, D3], name


def test_catch_up_repairs_a_chain_that_broke_off(lake, monkeypatch):
    daily.run_range(lake, D1, D1)
    with monkeypatch.context() as broken:
        broken.setattr(daily, "update_profit_lines", lambda *a, **b: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            daily.run_range(lake, D2, D2)
    daily.run_range(lake, D3, D3)
    assert daily.catch_up(lake, D3 + timedelta(days=1)) == (D2, D2)
    assert lake.table("agg_profit_daily", D2, D2).count() == 1
    assert daily.catch_up(lake, D3 + timedelta(days=1)) is None


@pytest.mark.parametrize(
    "query",
    [
        "SELECT sum(revenue) FROM fact_sales WHERE date = DATE '2025-03-15'",
        "SELECT sum(revenue) FROM fact_sales_all WHERE date BETWEEN DATE '2025-03-15' AND DATE '2025-03-16'",
        "SELECT count(*) FROM fact_inventory_moves WHERE movement_date >= DATE '2025-03-15'",
    ],
)
def test_a_date_filter_on_a_view_prunes_folders(lake, spark, query):
    daily.run_range(lake, D1, D3)
    lake.register_views()
    plan = spark.sql(query)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("PartitionFilters: []" not in line for line in scans)


def test_a_one_day_run_lists_only_its_own_folders(spark, folder, monkeypatch):
    from shelfledger.sources import lake as module

    rows = _daily(spark, [(D1 + timedelta(days=k), 1.0, 1, 1.0, 1) for k in range(200)])
    write_days(rows, folder)
    listed = []
    own = module.day_path
    monkeypatch.setattr(module, "day_path", lambda path, day: listed.append(day) or own(path, day))
    replace_days(_daily(spark, [(D2, 5.0, 1, 1.0, 1)]), folder, D2, D2)
    assert set(listed) == {D2}
