"""CSV inputs and file exports."""

from __future__ import annotations

import logging
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfledger import constants as K
from shelfledger.functions.columns import tax_multiplier

logger = logging.getLogger(__name__)

# Columns a beginning-cost file must have.
BEGINNING_COST_COLUMNS = ("product_id", "cost_unit", "purchase_tax_id")
# First inner field of the header row of a stock reconciliation file.
RECONCILE_HEADER = "Product/ID"


def read_beginning_costs(
    spark: SparkSession, path: str, effective: date = K.OPENING_COST_DATE
) -> DataFrame:
    """Tax-inclusive opening costs from a CSV file; bad ids or costs are fatal."""
    raw = spark.read.option("header", True).csv(path)
    missing = [name for name in BEGINNING_COST_COLUMNS if name not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return beginning_costs(raw, effective)


def beginning_costs(raw: DataFrame, effective: date = K.OPENING_COST_DATE) -> DataFrame:
    """Check and shape opening costs; one pass counts all rule violations."""
    notes = F.col("notes") if "notes" in raw.columns else F.lit("")
    costs = raw.select(
        F.nvl(F.col("product_id").try_cast("bigint"), F.lit(0)).alias("product_id"),
        F.nvl(F.col("cost_unit").try_cast("double"), F.lit(0.0)).alias("cost_unit"),
        F.nvl(F.col("purchase_tax_id").try_cast("bigint"), F.lit(0)).alias("source_tax_id"),
        F.nvl(notes, F.lit("")).alias("notes"),
    )
    found = costs.agg(
        F.count_if(F.col("product_id") <= 0).alias("bad_ids"),
        F.count_if(F.col("cost_unit") < 0).alias("bad_costs"),
        F.count_if(F.col("cost_unit") > K.COST_WARNING_LIMIT).alias("high_costs"),
    ).first()
    if found["bad_ids"]:
        raise ValueError(f"{found['bad_ids']} rows without a positive product_id")
    if found["bad_costs"]:
        raise ValueError(f"{found['bad_costs']} rows with a negative cost_unit")
    if found["high_costs"]:
        logger.warning("%d costs are above %d", found["high_costs"], K.COST_WARNING_LIMIT)
    return costs.select(
        "product_id",
        (F.col("cost_unit") * tax_multiplier(F.col("source_tax_id"))).alias("cost_unit_tax_in"),
        "source_tax_id",
        F.lit(effective).alias("effective_date"),
        F.lit(True).alias("is_active"),
        "notes",
    )


def read_ledger_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Opening quantity per product from a file whose first cell is itself a CSV row."""
    cells = spark.read.schema("cell string").option("escape", '"').csv(path)
    return ledger_baseline(cells)


def ledger_baseline(cells: DataFrame) -> DataFrame:
    """Sum of the inner field 3 per inner field 1; header and bad ids are left out."""
    inner = F.from_csv(
        F.col("cell"), "c0 string, c1 string, c2 string, c3 string", {"escape": '"'}
    )
    return (
        cells.where(F.col("cell").isNotNull() & (F.col("cell") != ""))
        .select(inner.alias("c"))
        .where(F.col("c.c0").isNull() | (F.col("c.c0") != RECONCILE_HEADER))
        .select(
            F.col("c.c1").try_cast("double").try_cast("bigint").alias("product_id"),
            F.nvl(F.col("c.c3").try_cast("double"), F.lit(0.0)).alias("qty"),
        )
        .where(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(F.sum("qty").alias("qty"))
    )


def export_csv(df: DataFrame, path: str) -> None:
    """CSV folder with a header in every part; a sorted frame stays sorted over the parts."""
    df.write.mode("overwrite").option("header", True).csv(path)


def export_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
