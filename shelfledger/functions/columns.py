"""Column expressions.  All of them stay inside generated code."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from shelfledger import constants as K
from shelfledger.schemas import Spec

_DAY_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
_SECOND_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


def tax_multiplier(tax_id: Column) -> Column:
    """Factor from net to tax-inclusive price."""
    return (
        F.when(tax_id.isin(*K.TAX_NEUTRAL_IDS), F.lit(1.0))
        .when(tax_id.isin(*K.TAX_VAT_IDS), F.lit(K.TAX_VAT_FACTOR))
        .otherwise(F.lit(1.0))
    )


def not_cancelled(ref: Column) -> Column:
    """True unless the reference is the cancelled mark; an unknown reference stays."""
    return ref.isNull() | (ref != K.CANCELLED_REF)


def ratio(top: Column, bottom: Column, scale: float = 1.0) -> Column:
    """top / bottom * scale, or 0 when the denominator is not positive."""
    share = top / bottom
    if scale != 1.0:
        share = share * F.lit(scale)
    return F.when(bottom > 0, share).otherwise(F.lit(0.0))


def zero_if_null(value: Column) -> Column:
    return F.nvl(value, F.lit(0.0))


def blank_as_null(text: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(text, F.lit(""))


def first_filled(*texts: Column) -> Column:
    """First text that is neither NULL nor empty."""
    return F.coalesce(*[blank_as_null(text) for text in texts])


def product_label(name: Column, product_id: Column) -> Column:
    return F.nvl(name, F.concat(F.lit("Product "), product_id.cast("string")))


def parse_day(text: Column) -> Column:
    """Date from YYYY-MM-DD text; anything else is NULL."""
    return F.when(text.rlike(_DAY_PATTERN), text.try_cast("date"))


def parse_second(text: Column) -> Column:
    """Zone-less timestamp from YYYY-MM-DD HH:MM:SS text; anything else is NULL."""
    return F.when(text.rlike(_SECOND_PATTERN), text.try_cast("timestamp_ntz"))


def local_timestamp(text: Column, zone: str = K.LOCAL_ZONE) -> Column:
    """UTC text to local wall-clock time, independent of the session zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), parse_second(text))


def as_json_ids(ids: Column) -> Column:
    """Array of ids as JSON text, e.g. ``[2, 7]``."""
    return F.concat(F.lit("["), F.array_join(ids.cast("array<string>"), ", "), F.lit("]"))


def day_range(column: Column, start: date, end: date) -> Column:
    """start <= column < end + 1 day, for dates and zone-less timestamps alike."""
    return (column >= _day(start)) & (column < _day(end + timedelta(days=1)))


def _day(value: date) -> Column:
    return F.expr(f"DATE'{value.isoformat()}'")


def moment(value: datetime) -> Column:
    """Literal zone-less timestamp."""
    return F.expr(f"TIMESTAMP_NTZ'{value:%Y-%m-%d %H:%M:%S}'")


def conform(df: DataFrame, spec: Spec) -> list[Column]:
    """Select list that gives ``df`` exactly the columns of ``spec``.

    Missing columns become the default, values that do not cast become NULL, and
    NULL becomes the default.  Extra columns are dropped.
    """
    present = set(df.columns)
    columns = []
    for name, kind, default in spec:
        value = F.col(name).try_cast(kind) if name in present else F.lit(None).cast(kind)
        if default is not None:
            value = F.nvl(value, F.lit(default).cast(kind))
        columns.append(value.alias(name))
    return columns


def contains_text(column: Column, needle: str) -> Column:
    """Case-insensitive literal containment; NULL text does not match."""
    return F.nvl(F.lower(column).contains(needle.lower()), F.lit(False))


def any_of(column: Column, values: Iterable) -> Column:
    """Membership test for a short list given by the caller."""
    return column.isin(*list(values))
