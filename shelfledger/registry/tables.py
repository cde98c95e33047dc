"""The given TPC-H-like tables seen as a retail business.

Every frame is derived by Spark from the given Parquet files and grows with
them.  ``shelfledger.registry.views`` holds the same definitions as SQL.  POS
amounts are whole units and other prices have endless decimals, so no rounded
result sits on a rounding tie.
"""

from __future__ import annotations

from datetime import date, datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfledger.functions.calendar import calendar
from shelfledger.operators.cleaning import clean_bills, load_fact
from shelfledger.operators.costs import cost_events
from shelfledger.operators.profit import (
    line_profit_by_day,
    profit_daily,
    profit_daily_by_product,
    taxed_sales,
)
from shelfledger.operators.sales import (
    combined_sales,
    sales_daily,
    sales_daily_by_principal,
    sales_daily_by_product,
)

# Whole range of order dates, a window inside it, and report days.
FIRST_DAY = date(1995, 1, 1)
LAST_DAY = date(2001, 8, 1)
HALF_START = date(1998, 4, 17)
AS_OF = date(2000, 6, 30)
EARLY_AS_OF = date(1996, 6, 30)
SNAPSHOT_DAY = date(2000, 6, 1)
BASELINE_LOCAL = datetime(1997, 2, 10, 7, 0, 0)
POOL = (1, 2, 3)


class Tables:
    """Lazy frames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- helpers --------------------------------------------------------------------

    @staticmethod
    def _ref(prefix: str, key: Column) -> Column:
        """Some documents are cancelled, some have no reference."""
        return (
            F.when(key % 97 == 0, F.lit("/"))
            .when(key % 89 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit(prefix), key.cast("string")))
        )

    @staticmethod
    def _line_id() -> Column:
        return F.col("l_orderkey") * 10 + F.col("l_linenumber")

    @staticmethod
    def _tax_id() -> Column:
        taxed = F.when(F.col("l_tax") >= 0.05, F.lit(7)).otherwise(F.lit(5))
        return taxed.cast("bigint").alias("tax_id")

    @staticmethod
    def _sold_at() -> Column:
        return F.col("o_orderdate") + F.make_dt_interval(
            F.lit(0), (F.col("o_orderkey") % 24).cast("int")
        )

    @cached_property
    def order_lines(self) -> DataFrame:
        return self.given("lineitem").join(
            self.given("orders"), F.col("l_orderkey") == F.col("o_orderkey")
        )

    # --- facts ------------------------------------------------------------------------

    @cached_property
    def fact_sales(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.order_lines.where(F.col("o_orderstatus") != "P").select(
            self._sold_at().alias("date"),
            key.alias("order_id"),
            self._ref("POS/", key).alias("order_ref"),
            (key % 4 + 1).alias("pos_config_id"),
            (F.col("o_custkey") % 50).alias("cashier_id"),
            F.col("o_custkey").alias("customer_id"),
            F.lit("[]").alias("payment_method_ids"),
            self._line_id().alias("line_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").alias("quantity"),
            F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")))
            .cast("double")
            .alias("revenue"),
        )

    @cached_property
    def fact_invoice_sales(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.order_lines.where(F.col("o_orderstatus") == "P").select(
            F.col("o_orderdate").cast("date").alias("date"),
            key.alias("move_id"),
            self._ref("INV/", key).alias("move_name"),
            F.col("o_custkey").alias("customer_id"),
            self._line_id().alias("move_line_id"),
            F.col("l_partkey").alias("product_id"),
            (F.col("l_extendedprice") / F.col("l_quantity") / F.lit(0.73)).alias("price_unit"),
            F.col("l_quantity").alias("quantity"),
            self._tax_id(),
        )

    @cached_property
    def raw_bills(self) -> DataFrame:
        price = F.col("l_extendedprice") / F.col("l_quantity") / F.lit(1.73)
        vendor = F.col("l_suppkey")
        return self.given("lineitem").where(F.col("l_returnflag") == "N").select(
            F.col("l_orderkey").alias("move_id"),
            F.concat(F.lit("BILL/"), F.col("l_orderkey").cast("string")).alias("move_name"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("move_date"),
            vendor.alias("vendor_id"),
            F.when(vendor % 10 == 0, F.lit(" "))
            .otherwise(F.concat(F.lit("Vendor "), vendor.cast("string")))
            .alias("vendor_name"),
            self._line_id().alias("move_line_id"),
            F.col("l_partkey").alias("product_id"),
            F.when(F.col("l_discount") >= 0.09, -price).otherwise(price).alias("price_unit"),
            F.col("l_quantity").alias("quantity"),
            self._tax_id(),
        )

    @cached_property
    def fact_purchases(self) -> DataFrame:
        return load_fact(clean_bills(self.raw_bills), "fact_purchases")

    @cached_property
    def fact_inventory_moves(self) -> DataFrame:
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        kind = (
            F.when((flag == "R") & (status == "F"), F.lit("incoming"))
            .when((flag == "R") & (status == "O"), F.lit("transfer"))
            .when((flag == "N") & (status == "F"), F.lit("production_in"))
            .when((flag == "N") & (status == "O"), F.lit("production_out"))
            .when((flag == "A") & (status == "F"), F.lit("adjustment"))
        )
        return self.given("lineitem").select(
            F.col("l_shipdate").alias("date"),
            F.col("l_orderkey").alias("move_id"),
            F.col("l_partkey").alias("product_id"),
            F.nullif(F.col("l_suppkey") % 10, F.lit(0)).alias("location_src_id"),
            (F.col("l_partkey") % 10).alias("location_dest_id"),
            F.col("l_quantity").alias("qty_moved"),
            kind.alias("movement_type"),
            F.nvl(kind == "adjustment", F.lit(False)).alias("inventory_adjustment_flag"),
        )

    @cached_property
    def stock_snapshots(self) -> DataFrame:
        """Part x month start; the calendar has a fixed number of rows per part."""
        months = F.sequence(F.lit(FIRST_DAY), F.lit(LAST_DAY), F.expr("interval 1 month"))
        return self.given("part").select(
            F.posexplode(months).alias("k", "snapshot_date"), "p_partkey"
        ).select(
            "snapshot_date",
            F.col("p_partkey").alias("product_id"),
            ((F.col("p_partkey") * 37 + F.col("k") * 11) % 200 - 5).cast("double").alias("quantity"),
        )

    # --- costs --------------------------------------------------------------------------

    @cached_property
    def cost_events(self) -> DataFrame:
        return cost_events(self.fact_purchases)

    @cached_property
    def legacy_costs(self) -> DataFrame:
        """Two generations of inherited costs for some products."""
        part = self.given("part")

        def generation(condition: Column, share: float, day: date, priority: int, source: str):
            return part.where(condition).select(
                F.col("p_partkey").alias("product_id"),
                (F.col("p_retailprice") * share).alias("cost_unit_tax_in"),
                F.lit(5).cast("bigint").alias("source_tax_id"),
                F.lit(day).alias("effective_date"),
                F.lit(source).alias("cost_source"),
                F.lit(priority).alias("priority"),
                (F.col("p_brand") != "Brand#7").alias("is_active"),
            )

        return generation(
            F.col("p_type").isin("STANDARD", "SMALL"), 0.5, date(1995, 1, 1), 3, "opening"
        ).unionByName(generation(F.col("p_size") > 40, 0.55, date(1996, 1, 1), 2, "estimate"))

    @cached_property
    def beginning_costs(self) -> DataFrame:
        return self.given("part").where(F.col("p_size") <= 25).select(
            F.col("p_partkey").alias("product_id"),
            (F.col("p_retailprice") * 0.5).alias("cost_unit_tax_in"),
            F.lit(5).cast("bigint").alias("source_tax_id"),
            F.lit(date(1995, 1, 1)).alias("effective_date"),
            (F.col("p_brand") != "Brand#7").alias("is_active"),
        )

    @cached_property
    def ledger_baseline(self) -> DataFrame:
        return self.given("part").where(F.col("p_type") == "PROMO").select(
            F.col("p_partkey").alias("product_id"), F.col("p_size").cast("double").alias("qty")
        )

    # --- dimension ------------------------------------------------------------------------

    @cached_property
    def dim_products(self) -> DataFrame:
        """The largest products are not in the catalogue, so fallback names occur."""
        key = F.col("p_partkey").cast("string")
        return self.given("part").where(F.col("p_size") < 50).select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("product_category"),
            F.when(F.col("p_size") <= 25, F.lit("Small"))
            .otherwise(F.lit("Large"))
            .alias("product_parent_category"),
            F.when(F.col("p_brand") == "Brand#13", F.lit(""))
            .otherwise(F.col("p_brand"))
            .alias("product_brand"),
            F.lpad(key, 13, "0").alias("product_barcode"),
            F.concat(F.lit("SKU-"), key).alias("product_sku"),
        )

    # --- derived facts ----------------------------------------------------------------------

    @cached_property
    def sales_all(self) -> DataFrame:
        return combined_sales(self.fact_sales, self.fact_invoice_sales)

    @cached_property
    def agg_sales_daily(self) -> DataFrame:
        return sales_daily(self.sales_all)

    @cached_property
    def agg_sales_by_product(self) -> DataFrame:
        return sales_daily_by_product(self.sales_all)

    @cached_property
    def agg_sales_by_principal(self) -> DataFrame:
        return sales_daily_by_principal(self.agg_sales_by_product, self.dim_products)

    @cached_property
    def taxed_lines(self) -> DataFrame:
        return taxed_sales(self.fact_sales, self.fact_invoice_sales)

    @cached_property
    def profit_lines(self) -> DataFrame:
        return line_profit_by_day(self.taxed_lines, self.cost_events, self.legacy_costs)

    @cached_property
    def agg_profit_daily(self) -> DataFrame:
        return profit_daily(self.profit_lines)

    @cached_property
    def agg_profit_by_product(self) -> DataFrame:
        return profit_daily_by_product(self.profit_lines)

    # --- staged records ------------------------------------------------------------------------

    @cached_property
    def staged_orders(self) -> DataFrame:
        """POS order headers; times are UTC text, a few of them unreadable."""
        key = F.col("o_orderkey")
        stamp = F.date_format(self._sold_at(), "yyyy-MM-dd HH:mm:ss")
        return self.given("orders").where(F.col("o_orderstatus") != "P").select(
            F.when(key % 500 == 7, F.lit("not a date")).otherwise(stamp).alias("order_date"),
            key.alias("order_id"),
            self._ref("POS/", key).alias("order_ref"),
            (key % 4 + 1).alias("pos_config_id"),
            (F.col("o_custkey") % 50).alias("cashier_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_totalprice").alias("amount_total"),
        )

    @cached_property
    def staged_order_lines(self) -> DataFrame:
        return self.given("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            self._line_id().alias("line_id"),
            F.nullif(F.col("l_partkey"), F.lit(0)).alias("product_id"),
            F.col("l_quantity").alias("qty"),
            F.col("l_extendedprice").alias("price_subtotal_incl"),
            F.when(
                F.col("l_discount") > 0, F.col("l_extendedprice") * F.col("l_discount")
            ).alias("discount_amount"),
        )

    @cached_property
    def staged_payments(self) -> DataFrame:
        refund = F.col("l_returnflag") == "R"
        return self.given("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            (F.col("l_suppkey") % 5 + 1).alias("method_id"),
            F.when(refund, -F.col("l_extendedprice"))
            .otherwise(F.col("l_extendedprice"))
            .alias("amount"),
        )

    @cached_property
    def raw_products(self) -> DataFrame:
        """Product attributes as the extract joins them."""
        return self.dim_products.withColumn("product_brand_id", F.lit(None).cast("bigint"))

    @cached_property
    def staged_documents(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.given("orders").select(
            F.col("o_orderkey").alias("move_id"),
            self._ref("DOC/", F.col("o_orderkey")).alias("move_name"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("move_date"),
            F.col("o_custkey").alias("partner_id"),
            F.concat(F.lit("Partner "), F.col("o_custkey").cast("string")).alias("partner_name"),
            F.when(status == "P", F.lit("out_invoice"))
            .when(status == "F", F.lit("in_invoice"))
            .otherwise(F.lit("entry"))
            .alias("move_type"),
            F.when(F.col("o_orderpriority") == "5-LOW", F.lit("draft"))
            .otherwise(F.lit("posted"))
            .alias("state"),
        )

    @cached_property
    def staged_document_lines(self) -> DataFrame:
        flag = F.col("l_returnflag")

        def ids(*values: int) -> Column:
            return F.array(*[F.lit(value).cast("bigint") for value in values])

        return self.given("lineitem").select(
            F.col("l_orderkey").alias("move_id"),
            self._line_id().alias("move_line_id"),
            F.col("l_partkey").alias("product_id"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_unit"),
            F.col("l_quantity").alias("quantity"),
            F.when(flag == "R", ids(7, 2, 7))
            .when(flag == "A", ids(6, 5))
            .alias("tax_ids"),
            (F.col("l_suppkey") + 1000).alias("purchase_order_id"),
            F.concat(F.lit("PO"), F.col("l_suppkey").cast("string")).alias("purchase_order_name"),
        )

    @cached_property
    def staged_move_lines(self) -> DataFrame:
        return self.given("lineitem").select(
            F.col("l_orderkey").alias("move_id"),
            self._line_id().alias("move_line_id"),
            F.when(F.col("l_tax") > 0, F.col("l_orderkey")).alias("picking_id"),
            F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("movement_date"),
            F.col("l_partkey").alias("product_id"),
            (F.col("l_suppkey") % 25).alias("location_src_id"),
            (F.col("l_partkey") % 25).alias("location_dest_id"),
            F.when(F.col("l_discount") > 0, F.col("l_quantity")).otherwise(F.lit(0.0)).alias("qty_done"),
            (F.col("l_suppkey") % 5).alias("uom_id"),
            F.when(F.col("l_linenumber") > 1, F.col("l_suppkey")).alias("create_uid"),
            F.when(
                F.col("l_linenumber") > 1, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
            ).alias("create_date"),
        )

    @cached_property
    def staged_moves(self) -> DataFrame:
        key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
        text = key.cast("string")
        return self.given("orders").select(
            key.alias("move_id"),
            F.concat(F.lit("MOVE/"), text).alias("name"),
            F.when(priority == "1-URGENT", F.lit(""))
            .otherwise(F.concat(F.lit("REF/"), text))
            .alias("reference"),
            F.concat(F.lit("SO"), text).alias("origin"),
            key.alias("picking_id"),
            (F.col("o_custkey") % 5).alias("picking_type_id"),
            F.when(F.col("o_orderstatus") == "P", F.lit("draft"))
            .otherwise(F.lit("done"))
            .alias("state"),
            F.when(priority == "2-HIGH", key + 1).alias("raw_material_production_id"),
            F.when(priority == "3-MEDIUM", key + 2).alias("production_id"),
            F.col("o_custkey").alias("create_uid"),
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("create_date"),
        )

    @cached_property
    def staged_pickings(self) -> DataFrame:
        key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
        return self.given("orders").where(F.col("o_orderstatus") == "F").select(
            key.alias("picking_id"),
            F.when(priority == "5-LOW", F.lit(""))
            .otherwise(F.concat(F.lit("PICK/"), key.cast("string")))
            .alias("name"),
            F.when(priority == "4-NOT SPECIFIED", F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("PO"), key.cast("string")))
            .alias("origin"),
            F.col("o_custkey").alias("partner_id"),
            F.when(priority != "4-NOT SPECIFIED", key % 5).alias("picking_type_id"),
        )

    @cached_property
    def staged_picking_types(self) -> DataFrame:
        key = F.col("r_regionkey")
        return self.given("region").select(
            key.cast("bigint").alias("picking_type_id"),
            F.when(key == 0, F.lit("incoming"))
            .when(key == 1, F.lit("internal"))
            .when(key == 2, F.lit("outgoing"))
            .when(key == 3, F.lit("mrp_operation"))
            .alias("code"),
        )

    @cached_property
    def staged_locations(self) -> DataFrame:
        region = F.col("n_regionkey")
        return self.given("nation").select(
            F.col("n_nationkey").cast("bigint").alias("location_id"),
            F.when(F.col("n_nationkey") > 2, F.concat(F.lit("WH/"), F.col("n_name")))
            .otherwise(F.lit(""))
            .alias("complete_name"),
            F.col("n_name").alias("name"),
            F.when(region == 0, F.lit("internal"))
            .when(region == 1, F.lit("supplier"))
            .when(region == 2, F.lit("customer"))
            .when(region == 3, F.lit("inventory"))
            .otherwise(F.lit("internal"))
            .alias("location_usage"),
            F.when(F.col("n_nationkey") % 8 == 0, F.lit(True)).alias("scrap_location"),
        )

    @cached_property
    def staged_products(self) -> DataFrame:
        key = F.col("p_partkey")
        parent = F.when(F.col("p_size") <= 25, F.lit("Small ")).otherwise(F.lit("Large"))
        return self.given("part").select(
            F.nullif(key, F.lit(0)).alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.when(F.col("p_size") == 50, F.lit(None).cast("string"))
            .when(F.col("p_size") == 49, F.lit(" / "))
            .otherwise(F.concat(parent, F.lit("/ "), F.col("p_brand"), F.lit(" / "), F.col("p_type")))
            .alias("category_path"),
            F.when(F.col("p_brand") == "Brand#13", F.lit(""))
            .otherwise(F.col("p_brand"))
            .alias("brand_name"),
            F.length("p_brand").cast("bigint").alias("product_brand_id"),
            F.lpad(key.cast("string"), 13, "0").alias("product_barcode"),
            F.concat(F.lit("SKU-"), key.cast("string")).alias("product_sku"),
        )

    @cached_property
    def staged_quants(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.given("part").select(
            key.alias("quant_id"),
            F.when(F.col("p_size") < 50, key).alias("product_id"),
            (key % 25).alias("location_id"),
            F.when(F.col("p_size") > 25, key + 7).alias("lot_id"),
            F.lit(None).cast("bigint").alias("owner_id"),
            F.lit(1).cast("bigint").alias("company_id"),
            (key % 40 - 5).cast("double").alias("quantity"),
            (key % 3).cast("double").alias("reserved_quantity"),
        )

    def calendar(self, unit: str = "day") -> DataFrame:
        return calendar(self.spark, FIRST_DAY, LAST_DAY, unit)
