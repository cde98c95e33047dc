"""Record shaping and dimension edge cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfledger.operators import dimensions, shaping
from shelfledger.schemas import FACT_INVENTORY_MOVES, column_names


@pytest.mark.parametrize(
    "src, dest, qty, expected",
    [
        ("internal", "customer", 4.0, -4.0),
        ("supplier", "internal", -4.0, 4.0),
        ("internal", "internal", 4.0, 4.0),
        (None, "internal", 4.0, 4.0),
        ("internal", None, 4.0, -4.0),
        ("supplier", "customer", -4.0, -4.0),
    ],
)
def test_signed_quantity(spark, src, dest, qty, expected):
    df = spark.createDataFrame([(src, dest, qty)], "s string, d string, q double")
    found = df.select(shaping.signed_quantity(F.col("q"), F.col("s"), F.col("d"))).first()[0]
    assert found == expected


@pytest.mark.parametrize(
    "code, src, dest, scrap, raw, prod, expected",
    [
        ("incoming", "supplier", "internal", False, None, None, "incoming"),
        ("internal", "internal", "internal", None, None, None, "transfer"),
        ("outgoing", "internal", "customer", False, None, None, None),
        ("internal", "internal", "production", False, 5, None, "production_out"),
        ("internal", "production", "internal", False, None, 6, "production_in"),
        ("incoming", "inventory", "internal", False, None, None, "adjustment"),
        ("incoming", "inventory", "internal", False, 5, 6, "production_out"),
        ("internal", "internal", "inventory", True, 5, None, None),
    ],
)
def test_movement_type_precedence(spark, code, src, dest, scrap, raw, prod, expected):
    df = spark.createDataFrame(
        [(code, src, dest, scrap, raw, prod)],
        "code string, src string, dest string, scrap boolean, raw long, prod long",
    )
    names = ("code", "src", "dest", "scrap", "raw", "prod")
    assert df.select(shaping.movement_type(*[F.col(n) for n in names])).first()[0] == expected


def test_primary_tax(spark):
    df = spark.createDataFrame([([7, 2, 7],), ([],), (None,), ([None, 6],)], "t array<long>")
    tax, json = shaping.primary_tax(F.col("t"))
    rows = [tuple(r) for r in df.select(tax, json).collect()]
    assert rows == [(2, "[2, 7]"), (None, "[]"), (None, "[]"), (6, "[6]")]


def test_payment_methods_and_pos_lines(spark):
    orders = spark.createDataFrame(
        [(1, "2025-03-15 01:00:00", "POS/1", 9.0), (2, "2025-03-15 02:00:00", "POS/2", None)],
        "order_id long, order_date string, order_ref string, amount_total double",
    ).withColumns(
        {n: F.lit(None).cast("long") for n in ("pos_config_id", "cashier_id", "customer_id")}
    )
    lines = spark.createDataFrame(
        [(1, 10, 7, 2.0, 9.0, None), (1, 11, None, 1.0, 1.0, None), (3, 12, 7, 1.0, 1.0, None)],
        "order_id long, line_id long, product_id long, qty double, price_subtotal_incl double,"
        " discount_amount double",
    )
    payments = spark.createDataFrame(
        [(1, 4, 5.0), (1, 2, 4.0), (1, 4, 1.0), (1, 9, -1.0), (1, 8, 0.0)],
        "order_id long, method_id long, amount double",
    )
    products = spark.createDataFrame(
        [(8, "B", 1, "n", "c", "p")],
        "product_id long, product_brand string, product_brand_id long, product_name string,"
        " product_category string, product_parent_category string",
    )
    rows = shaping.pos_lines(orders, lines, payments, products).collect()
    assert [(r["order_id"], r["line_id"]) for r in rows] == [(1, 10)]
    assert rows[0]["payment_method_ids"] == "[2, 4]"
    assert rows[0]["product_brand"] == "Unknown" and rows[0]["discount_amount"] == 0.0
    free = shaping.pos_lines(orders, lines, payments.limit(0), products).first()
    assert free["payment_method_ids"] == "[]"


@pytest.mark.parametrize(
    "path, parent, leaf",
    [
        ("Food / Drinks / Tea", "Food", "Tea"),
        ("Food", "Food", "Food"),
        (" / Food / ", "Food", "Food"),
        ("", None, None),
        (None, None, None),
    ],
)
def test_category_path(spark, path, parent, leaf):
    df = spark.createDataFrame([(path,)], "p string")
    assert tuple(df.select(*dimensions.category_path(F.col("p"))).first()) == (parent, leaf)


def test_reference_falls_back_past_empty_text(spark):
    from shelfledger.functions.columns import first_filled

    df = spark.createDataFrame([("", None, "MOVE/1"), ("P", "R", "M")], "a string, b string, c string")
    found = [r[0] for r in df.select(first_filled(*[F.col(c) for c in "abc"])).collect()]
    assert found == ["MOVE/1", "P"]


def test_quant_snapshot(spark):
    quants = spark.createDataFrame([(1, 5.0), (2, 0.0), (None, 3.0)], "quant_id long, quantity double")
    rows = shaping.quant_snapshot(quants, date(2025, 3, 15)).collect()
    assert [(r["quant_id"], r["snapshot_date"]) for r in rows] == [(1, "2025-03-15")]


def test_move_fact_columns():
    # The storage contract of the moves fact.
    assert column_names(FACT_INVENTORY_MOVES) == [
        "date", "move_id", "move_line_id", "product_id", "product_name", "product_brand",
        "location_src_id", "location_src_name", "location_src_usage", "location_dest_id",
        "location_dest_name", "location_dest_usage", "qty_moved", "uom_id", "uom_name",
        "uom_category", "movement_type", "inventory_adjustment_flag", "manufacturing_order_id",
        "picking_id", "picking_type_code", "reference", "origin_reference", "source_partner_id",
        "source_partner_name", "destination_partner_id", "destination_partner_name",
        "created_by_user", "create_date",
    ]
