"""Column expressions, calendars and the distributed ranking."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from shelfledger.functions import calendar as C
from shelfledger.functions import columns as X
from shelfledger.functions.ranking import global_rank


def _values(df, column):
    return [row["v"] for row in df.select(column.alias("v")).collect()]


def test_tax_multiplier(spark):
    df = spark.createDataFrame([(5,), (2,), (7,), (6,), (99,), (None,)], "tax_id long")
    assert _values(df, X.tax_multiplier(F.col("tax_id"))) == [1.0, 1.0, 1.11, 1.11, 1.0, 1.0]


def test_cancelled_reference_is_dropped_and_unknown_kept(spark):
    df = spark.createDataFrame([("/",), (None,), ("",), ("POS/1",)], "r string")
    assert _values(df, X.not_cancelled(F.col("r"))) == [False, True, True, True]


def test_local_time_of_utc_text(spark):
    df = spark.createDataFrame(
        [("2025-03-14 18:00:00",), ("2025-03-14",), ("soon",), (None,)], "t string"
    )
    expected = [datetime(2025, 3, 15, 1), None, None, None]
    for zone in ("UTC", "America/New_York"):  # the session zone plays no part
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert _values(df, X.local_timestamp(F.col("t"))) == expected
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_parse_day_is_strict(spark):
    df = spark.createDataFrame([("2025-02-30",), ("2025-02-03",), ("2025-2-3",)], "t string")
    assert _values(df, X.parse_day(F.col("t"))) == [None, date(2025, 2, 3), None]


def test_day_range_takes_the_whole_last_day(spark):
    df = spark.createDataFrame(
        [("2025-01-01 23:59:59",), ("2025-01-02 00:00:00",), ("2024-12-31 23:00:00",)], "t string"
    ).select(F.col("t").cast("timestamp_ntz").alias("t"))
    inside = X.day_range(F.col("t"), date(2025, 1, 1), date(2025, 1, 1))
    assert _values(df, inside) == [True, False, False]


def test_ratio_and_json(spark):
    df = spark.createDataFrame([(6.0, 3.0), (6.0, 0.0), (6.0, -1.0)], "a double, b double")
    assert _values(df, X.ratio(F.col("a"), F.col("b"))) == [2.0, 0.0, 0.0]
    ids = spark.createDataFrame([([7, 2],), ([],)], "i array<long>")
    assert _values(ids, X.as_json_ids(F.col("i"))) == ["[7, 2]", "[]"]


def test_conform_fills_casts_and_drops(spark):
    df = spark.createDataFrame([("x", "3", 1)], "a string, b string, extra int")
    spec = [("a", "bigint", None), ("b", "double", 0.0), ("c", "string", "none"), ("d", "date", None)]
    row = df.select(*X.conform(df, spec)).first()
    assert tuple(row) == (None, 3.0, "none", None)


@pytest.mark.parametrize(
    "preset, expected",
    [
        ("weekly", (date(2025, 8, 8), date(2025, 8, 14))),
        ("monthly", (date(2025, 8, 1), date(2025, 8, 14))),
        ("mtd", (date(2025, 8, 1), date(2025, 8, 14))),
        ("quarterly", (date(2025, 7, 1), date(2025, 8, 14))),
        ("qtd", (date(2025, 7, 1), date(2025, 8, 14))),
        ("semesterly", (date(2025, 7, 1), date(2025, 8, 14))),
        ("yearly", (date(2025, 1, 1), date(2025, 8, 14))),
        ("last_month", (date(2025, 7, 1), date(2025, 7, 31))),
        ("today", (date(2025, 8, 14), date(2025, 8, 14))),
    ],
)
def test_presets(preset, expected):
    assert C.preset_range(preset, date(2025, 8, 14)) == expected


def test_last_month_over_new_year():
    assert C.preset_range("last_month", date(2025, 1, 31)) == (date(2024, 12, 1), date(2024, 12, 31))


def test_calendar_buckets(spark):
    weeks = [r[0] for r in C.calendar(spark, date(2025, 1, 1), date(2025, 1, 14), "week").collect()]
    assert weeks == [date(2024, 12, 30), date(2025, 1, 6), date(2025, 1, 13)]
    months = [r[0] for r in C.calendar(spark, date(2025, 1, 31), date(2025, 3, 1), "month").collect()]
    assert months == [date(2025, 1, 1), date(2025, 2, 1), date(2025, 3, 1)]
    assert C.previous_window(date(2025, 1, 11), date(2025, 1, 20)) == (
        date(2025, 1, 1),
        date(2025, 1, 10),
    )


def test_unknown_period():
    with pytest.raises(ValueError):
        C.unit_of("hourly")


@pytest.mark.parametrize("ties", [False, True])
def test_global_rank_over_many_ranges(spark, ties):
    # Coalescing is off, so the ranking really spans several ranges.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        value = F.lit(1.0) if ties else ((F.col("id") * 7919) % 1009).cast("double")
        df = spark.range(5000).select(F.col("id"), value.alias("v"))
        ranked = global_rank(df, [F.col("v").desc(), F.col("id").asc()], "v")
        rows = ranked.orderBy("sku_rank").collect()
        expected = sorted(((r["v"], r["id"]) for r in rows), key=lambda p: (-p[0], p[1]))
        assert [(r["v"], r["id"]) for r in rows] == expected
        assert [r["sku_rank"] for r in rows] == list(range(1, 5001))
        running = 0.0
        for row in rows:
            running += row["v"]
            assert row["cumulative_revenue"] == pytest.approx(running)
        assert {r["sku_count"] for r in rows} == {5000}
        assert {r["total_revenue"] for r in rows} == {running}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
