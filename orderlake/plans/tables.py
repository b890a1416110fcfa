"""The typed tables the reports rest on, written once and read many times."""

from __future__ import annotations

from pyspark.sql import DataFrame

from orderlake.operators.orders import order_level
from orderlake.operators.typed import typed_lines
from orderlake.plans import reports


def build_tables(lines: DataFrame, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """Write ``lines`` (typed) and ``orders`` (one row an order) under ``path``.

    Choosing the first line of each order is the one wide step of the reports;
    written down, it is done once instead of once a report.
    """
    spark = lines.sparkSession
    line_path, order_path = f"{path.rstrip('/')}/lines", f"{path.rstrip('/')}/orders"
    typed_lines(lines, **options).write.mode("overwrite").parquet(line_path)
    silver = spark.read.parquet(line_path)
    order_level(silver).write.mode("overwrite").parquet(order_path)
    return silver, spark.read.parquet(order_path)


def all_reports(lines: DataFrame, orders: DataFrame) -> dict[str, DataFrame]:
    """Every dashboard report as a lazy frame."""
    members = reports.customer_value(orders)
    return {
        "kpis": reports.kpis(lines, orders),
        "category_mix": reports.category_mix(lines),
        "revenue_by_month": reports.revenue_by_month(orders),
        "top_products": reports.top_products(lines),
        "customer_value": members,
        "loyalty_kpis": reports.loyalty_kpis(members),
        "loyalty_segments": reports.loyalty_segments(members),
        "orders_by_state": reports.orders_by_state(orders),
        "summary_stats": reports.summary_stats(lines),
        "summary_top_products": reports.summary_top_products(lines),
        "summary_sources": reports.summary_sources(lines),
    }
