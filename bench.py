"""Local benchmark: prints one JSON line.

The retail tables are written as Parquet (timed as ``build_*``), as the daily
jobs would leave them; the report queries then read those tables.  A table is
written once to warm up and once more for its time.  Each report is timed over
RUNS runs after one warm-up; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from datetime import date, datetime, timedelta
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shelfledger.operators import abc, actions, costs, profit, sales, sell_through, stock  # noqa: E402
from shelfledger.registry.tables import BASELINE_LOCAL, POOL, Tables  # noqa: E402
from shelfledger.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

END = date(2000, 6, 30)
START = END - timedelta(days=29)
YEAR = END - timedelta(days=364)
FIRST, LAST = date(1995, 1, 1), date(2001, 8, 1)


def write_table(df, path: str) -> None:
    df.write.option("compression", "zstd").parquet(path)


def main() -> None:
    spark = local_session(CPUS, int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    given = Tables(spark, SF_DIR)
    store = tempfile.mkdtemp(prefix="shelfledger-bench-")
    timings: dict[str, float] = {}

    def build(name: str, df):
        write_table(df, f"{store}/warm-up/{name}")
        started = time.perf_counter()
        write_table(df, f"{store}/{name}")
        timings[f"build_{name}"] = round(time.perf_counter() - started, 3)
        return spark.read.parquet(f"{store}/{name}")

    pos = build("fact_sales", given.fact_sales)
    invoices = build("fact_invoice_sales", given.fact_invoice_sales)
    purchases = build("fact_purchases", given.fact_purchases)
    moves = build("fact_inventory_moves", given.fact_inventory_moves)
    snapshots = build("stock_snapshots", given.stock_snapshots)
    products = build("dim_products", given.dim_products)
    lines = sales.combined_sales(pos, invoices)
    daily = build("agg_sales_daily", sales.sales_daily(lines))
    by_product = build("agg_sales_daily_by_product", sales.sales_daily_by_product(lines))
    by_principal = build(
        "agg_sales_daily_by_principal", sales.sales_daily_by_principal(by_product, products)
    )
    events = build("cost_events", costs.cost_events(purchases))
    profit_lines = build(
        "profit_lines",
        profit.line_profit_by_day(profit.taxed_sales(pos, invoices), events, given.legacy_costs),
    )
    profit_daily = build("agg_profit_daily", profit.profit_daily(profit_lines))
    profit_by_product = build(
        "agg_profit_daily_by_product", profit.profit_daily_by_product(profit_lines)
    )
    opening, beginning = given.ledger_baseline, given.beginning_costs

    def ledger():
        return stock.ledger_stock(
            opening, moves, lines, products, END, baseline_local=BASELINE_LOCAL, pool=POOL
        )

    def position():
        unit_costs = costs.inventory_cost(events, beginning, END)
        classes = abc.abc_classes(by_product, products, START, END)
        return actions.stock_position(ledger(), classes, unit_costs)

    reports = {
        "sales_trend_30d": lambda: sales.sales_trend(daily, START, END),
        "revenue_comparison_30d": lambda: sales.revenue_comparison(daily, START, END),
        "top_products_30d": lambda: sales.top_products(by_product, products, START, END),
        "sales_by_principal_30d": lambda: sales.sales_by_principal(by_principal, START, END),
        "sales_trend_year_weekly": lambda: sales.sales_trend(daily, YEAR, END, "weekly"),
        "top_products_year": lambda: sales.top_products(by_product, products, YEAR, END),
        "overview_year": lambda: sales.overview_summary(by_product, products, YEAR, END),
        "hourly_pattern_day": lambda: sales.hourly_pattern(lines, END),
        "hourly_heatmap_30d": lambda: sales.hourly_heatmap(lines, START, END),
        "profit_summary_30d": lambda: profit.profit_summary(profit_daily, START, END),
        "profit_trend_30d": lambda: profit.profit_trend(profit_daily, START, END),
        "profit_by_product_30d": lambda: profit.profit_by_product(
            profit_by_product, products, START, END
        ),
        "executive_kpis_30d": lambda: profit.executive_kpis(profit_daily, START, END),
        "sales_range_totals_week": lambda: sales.range_totals(pos, END - timedelta(days=6), END),
        "sales_product_join": lambda: sales.product_join_totals(pos, products, START),
        "monthly_sales": lambda: sales.monthly_sales(pos, YEAR),
        "category_rollup": lambda: sales.category_rollup(pos, products, START),
        "ledger_deltas": lambda: stock.ledger_deltas(
            moves,
            stock.utc_of(BASELINE_LOCAL),
            stock.utc_of(datetime(END.year, END.month, END.day, 7)),
            POOL,
        ),
        "ledger_stock": ledger,
        "inventory_summary_cards": lambda: stock.summary_cards(
            stock.stock_status(snapshots, by_product, date(2000, 6, 1))
        ),
        "sell_through_year": lambda: sell_through.sell_through(
            snapshots, by_product, products, YEAR, END
        ),
        "abc_30d": lambda: abc.abc_classes(by_product, products, START, END),
        "action_summary": lambda: actions.action_summary(position()),
        "cost_snapshot": lambda: costs.cost_snapshot(events, END),
        "cost_history_30d": lambda: costs.cost_history(events, START, END),
    }
    for name, report in reports.items():
        report().write.format("noop").mode("overwrite").save()
        runs = []
        for _ in range(RUNS):
            started = time.perf_counter()
            report().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        timings[name] = round(statistics.median(runs), 3)

    print(
        json.dumps(
            {
                "metric": "retail jobs and reports, total wall time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
