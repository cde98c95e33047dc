"""Plan shapes that have to hold when the tables grow."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfledger.operators import cleaning, profit, sales, shaping
from shelfledger.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"

# Windows over a whole frame that holds one row per day, category or range.
BOUNDED_WINDOWS = {
    "missing_date_ranges",
    "parent_category_totals",
}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_unbounded_step(spark, name):
    plan = _plan(QUERIES[name].frame(spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"Python|Pandas|ArrowEval", plan)
    ranks = re.findall(r"Window \[.*?windowspecdefinition\((.*?)\)", plan)
    ranked = "Scan ExistingRDD" in plan  # offsets of a distributed ranking: one row per range
    if not ranked and name not in BOUNDED_WINDOWS:
        for spec in ranks:
            assert "product_id" in spec or "_range" in spec, spec


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(
        sales.range_totals(
            spark.read.parquet(f"{FOLDER}/lineitem.parquet").select(
                F.col("l_shipdate").alias("date"), F.col("l_extendedprice").alias("revenue")
            ),
            date(2000, 1, 1),
            date(2000, 1, 31),
        )
    )
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan
    deltas = _plan(QUERIES["ledger_deltas"].frame(spark, FOLDER))
    assert "l_extendedprice" not in deltas and "GreaterThan(l_shipdate" in deltas



@pytest.fixture
def small_partitions(spark):
    """Thresholds scaled down, so that test data shows what big data would."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def _hot(spark, rows=60_000):
    """Lines of which every second belongs to product 7."""
    key = F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 1000)
    return spark.range(0, rows, 1, 8).select(
        F.lit("pos").alias("channel"),
        F.lit(date(2025, 3, 15)).alias("date"),
        F.col("id").alias("txn_id"),
        F.col("id").alias("line_id"),
        key.alias("product_id"),
        F.lit(1.0).alias("quantity"),
        F.rand(1).alias("revenue_tax_in"),
    )


def test_hot_product_is_split_in_the_cost_join(spark, small_partitions):
    """The costs are grouped by product, as unified costs are."""
    offers = spark.range(5000).select(
        (F.col("id") % 1000).alias("product_id"),
        F.col("id").cast("double").alias("cost_unit_tax_in"),
        F.lit(5).cast("bigint").alias("source_tax_id"),
    )
    costs = offers.groupBy("product_id").agg(
        F.max("cost_unit_tax_in").alias("cost_unit_tax_in"),
        F.max("source_tax_id").alias("source_tax_id"),
    )
    lines = profit.line_profit(_hot(spark), costs)
    assert len(lines.collect()) == 60_000
    assert "skew=true" in _plan(lines)
    assert lines.where("cost_missing").isEmpty()


def test_hot_product_day_is_split_in_the_day_cost_join(spark, small_partitions, tmp_path):
    path = str(tmp_path / "lines")
    _hot(spark).write.parquet(path)
    events = spark.range(2000).select(
        F.lit(date(2025, 3, 1)).alias("date"),
        (F.col("id") % 1000).alias("product_id"),
        F.col("id").cast("double").alias("cost_unit_tax_in"),
        F.col("id").alias("source_move_id"),
        F.lit(5).cast("bigint").alias("source_tax_id"),
    )
    lines = profit.line_profit_as_of(spark.read.parquet(path), events)
    assert len(lines.collect()) == 60_000
    assert "skew=true" in _plan(lines)
    assert lines.where("cost_missing").isEmpty()


def test_hot_document_is_split_in_discount_allocation(spark, small_partitions):
    lines = _hot(spark).select(
        F.col("product_id").alias("move_id"),
        F.col("line_id").alias("move_line_id"),
        F.when(F.col("line_id") % 50 == 2, -1.0).otherwise(4.0).alias("price_unit"),
        F.lit(1.0).alias("quantity"),
        F.col("revenue_tax_in"),
    )
    priced = cleaning.allocate_discounts(lines)
    assert len(priced.collect()) == 60_000
    assert "skew=true" in _plan(priced)


def test_hot_order_is_split_in_the_line_builder(spark, small_partitions):
    lines = _hot(spark).select(
        F.col("product_id").alias("order_id"),
        "line_id",
        (F.col("line_id") % 50).alias("product_id"),
        F.lit(1.0).alias("qty"),
        F.col("revenue_tax_in").alias("price_subtotal_incl"),
        F.lit(0.0).alias("discount_amount"),
    )
    orders = spark.range(1000).select(
        F.col("id").alias("order_id"),
        F.lit("2025-03-15 01:00:00").alias("order_date"),
        F.lit("POS").alias("order_ref"),
        F.lit(1).cast("bigint").alias("pos_config_id"),
        F.lit(1).cast("bigint").alias("cashier_id"),
        F.lit(1).cast("bigint").alias("customer_id"),
        F.lit(1.0).alias("amount_total"),
    )
    payments = spark.range(4000).select(
        (F.col("id") % 1000).alias("order_id"),
        (F.col("id") % 3).alias("method_id"),
        F.lit(1.0).alias("amount"),
    )
    products = spark.range(50).select(
        F.col("id").alias("product_id"),
        F.lit("B").alias("product_brand"),
        F.lit(1).cast("bigint").alias("product_brand_id"),
        F.lit("n").alias("product_name"),
        F.lit("c").alias("product_category"),
        F.lit("p").alias("product_parent_category"),
    )
    shaped = shaping.pos_lines(orders, lines, payments, products)
    assert len(shaped.collect()) == 60_000
    assert "skew=true" in _plan(shaped)


def test_hot_keys_are_split_in_dimension_joins(spark, small_partitions):
    pos = _hot(spark).select(
        F.lit("2025-03-15 10:00:00").cast("timestamp_ntz").alias("date"),
        F.col("txn_id").alias("order_id"),
        "product_id",
        (F.col("revenue_tax_in") + 1).alias("revenue"),
    )
    products = spark.range(1000).select(
        F.col("id").alias("product_id"),
        (F.col("id") % 5).cast("string").alias("product_category"),
        F.concat(F.lit("P"), F.col("id").cast("string")).alias("product_name"),
        F.lit("B").alias("product_brand"),
    )
    rollup = sales.category_rollup(pos, products, date(2025, 1, 1))
    assert sum(r["orders"] for r in rollup.collect()) == 60_000
    assert "skew=true" in _plan(rollup)

    raw = _hot(spark).select(
        F.col("txn_id").alias("move_id"),
        "product_id",
        F.col("product_id").alias("location_src_id"),
        (F.col("line_id") % 100).alias("location_dest_id"),
        F.col("quantity").alias("qty_moved"),
        F.lit(1).cast("bigint").alias("uom_id"),
    )
    locations = spark.range(1000).select(
        F.col("id").alias("location_id"),
        F.concat(F.lit("L"), F.col("id").cast("string")).alias("location_name"),
        F.lit("internal").alias("location_usage"),
    )
    uoms = spark.range(5).select(
        F.col("id").alias("uom_id"), F.lit("u").alias("uom_name"), F.lit("c").alias("uom_category")
    )
    partners = spark.range(5).select(F.col("id").alias("partner_id"), F.lit("p").alias("partner_name"))
    moves = cleaning.clean_moves(raw, products, locations, uoms, partners)
    rows = moves.collect()
    assert len(rows) == 60_000 and all(r["product_name"] for r in rows)
    assert _plan(moves).split("Initial Plan")[0].count("skew=true") == 2  # product and source


def test_hot_day_is_spread_before_transactions_are_counted(spark, tmp_path):
    path = str(tmp_path / "lines")
    _hot(spark).withColumnRenamed("revenue_tax_in", "revenue").write.parquet(path)
    daily = sales.sales_daily(spark.read.parquet(path))
    plan = _plan(daily)
    assert re.search(r"hashpartitioning\(date#\d+, channel#\d+, txn_id#\d+L", plan)
    assert "Expand" not in plan
    assert daily.first()["transactions"] == 60_000


def test_lineage_is_cut_in_the_shared_folder(spark, tmp_path):
    from shelfledger.session import cut_lineage

    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert "Scan ExistingRDD" in _plan(df) and df.count() == 10
    assert spark.sparkContext.getCheckpointDir() is not None


def test_interval_costs_read_the_sales_once(spark):
    """Lines meet month pieces of the cost intervals; no sale is looked at to make the costs."""
    from datetime import date

    from shelfledger.operators import costs, profit

    sales = spark.range(100).selectExpr(
        "'pos' AS channel", "date_add(DATE '2025-01-01', CAST(id % 90 AS INT)) AS date", "id AS txn_id",
        "id AS line_id", "id % 5 AS product_id", "1.0D AS quantity", "9.0D AS revenue_tax_in",
    )
    events = spark.createDataFrame(
        [(date(2025, 1, 10), 1, 3.0, 1, 5), (date(2025, 3, 2), 1, 4.0, 2, 5), (date(2025, 2, 1), 2, 5.0, 3, 5)],
        "date date, product_id bigint, cost_unit_tax_in double, source_move_id bigint, source_tax_id bigint",
    )
    legacy = spark.createDataFrame(
        [], "product_id bigint, priority int, effective_date date, cost_unit_tax_in double, source_tax_id bigint, cost_source string, is_active boolean"
    )
    intervals = costs.unified_cost_intervals(events, legacy)
    found = profit.line_profit_in_intervals(sales, intervals, date(2025, 1, 1), date(2025, 3, 31))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 100") == 1
    plain = profit.line_profit_by_day(sales, events, legacy)
    columns = found.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.select(*columns).collect()))
