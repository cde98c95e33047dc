"""Dimension tables from staged entity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfledger import constants as K
from shelfledger.functions.columns import conform, first_filled
from shelfledger.schemas import (
    DIM_COMPANIES,
    DIM_LOCATIONS,
    DIM_LOTS,
    DIM_PARTNERS,
    DIM_PRODUCTS,
    DIM_UOMS,
    DIM_USERS,
    Spec,
)


def category_path(path: Column) -> tuple[Column, Column]:
    """(first, last) non-empty trimmed segment of ``A / B / C``."""
    trimmed = F.transform(F.split(path, "/"), lambda part: F.trim(part))
    parts = F.filter(trimmed, lambda part: part != "")
    return F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1)


def _entity(df: DataFrame, spec: Spec, **derived: Column) -> DataFrame:
    """Rows with a valid id, shaped to the dimension's columns."""
    frame = df.withColumns(derived) if derived else df
    key = spec[0][0]
    return frame.select(*conform(frame, spec)).where(F.col(key).isNotNull())


def dim_products(products: DataFrame) -> DataFrame:
    """``category_path`` and ``brand_name`` become parent, leaf and brand."""
    parent, leaf = category_path(F.col("category_path"))
    return _entity(
        products,
        DIM_PRODUCTS,
        product_parent_category=parent,
        product_category=leaf,
        product_brand=F.nvl(first_filled(F.col("brand_name")), F.lit(K.UNKNOWN)),
    )


def dim_locations(locations: DataFrame) -> DataFrame:
    return _entity(
        locations,
        DIM_LOCATIONS,
        location_name=first_filled(F.col("complete_name"), F.col("name")),
    )


def dim_uoms(uoms: DataFrame) -> DataFrame:
    return _entity(uoms, DIM_UOMS)


def dim_partners(partners: DataFrame) -> DataFrame:
    return _entity(partners, DIM_PARTNERS)


def dim_users(users: DataFrame) -> DataFrame:
    return _entity(users, DIM_USERS)


def dim_companies(companies: DataFrame) -> DataFrame:
    return _entity(companies, DIM_COMPANIES)


def dim_lots(lots: DataFrame) -> DataFrame:
    return _entity(lots, DIM_LOTS)
