"""Reports over silver order lines.

Functions taking ``orders`` expect ``order_level(lines)``; write that frame
once and pass the written table when several reports are wanted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlake.functions.products import DEFAULT_CATALOG, Catalog, category_of
from orderlake.functions.values import month_of, to_date

# Segment labels with the largest order count of each.
SEGMENTS = (("One-time", 1), ("Repeat (2-3)", 3), ("Loyal (4-6)", 6), ("VIP (7+)", None))
LOYAL_FROM = 4


def _total(amount: str) -> Column:
    """Exact sum as a double; amounts that are missing throughout give 0."""
    return F.coalesce(F.sum(amount).cast("double"), F.lit(0.0))


def _count() -> Column:
    return F.count(F.lit(1))


def kpis(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders, line items, distinct members and revenue, in one row."""
    by_line = lines.agg(
        _count().alias("line_items"),
        F.countDistinct("Customer_Name").alias("members"),
    )
    by_order = orders.agg(_count().alias("orders"), F.sum("Total_Amount").alias("revenue"))
    both = by_line.unionByName(by_order, allowMissingColumns=True)
    return both.agg(
        F.max("orders").alias("orders"),
        F.max("line_items").alias("line_items"),
        F.max("members").alias("members"),
        F.coalesce(F.max("revenue").cast("double"), F.lit(0.0)).alias("revenue"),
    )


def category_mix(lines: DataFrame) -> DataFrame:
    """Line items per category, most first."""
    return (
        lines.groupBy("Category")
        .agg(F.count("Order_Number").alias("line_items"))
        .orderBy(F.desc("line_items"), "Category")
    )


def revenue_by_month(orders: DataFrame) -> DataFrame:
    """Order revenue per month; orders without a date are left out."""
    return (
        orders.filter(F.col("Date_parsed").isNotNull())
        .groupBy(month_of(F.col("Date_parsed")).alias("Month"))
        .agg(_total("Total_Amount").alias("revenue"))
        .orderBy("Month")
    )


def top_products(
    lines: DataFrame, n: int = 8, catalog: Catalog = DEFAULT_CATALOG
) -> DataFrame:
    """The ``n`` most frequent products; ties by code, then description."""
    return (
        lines.groupBy("Product_Code", "Product_Description")
        .agg(_count().alias("line_items"))
        .orderBy(F.desc("line_items"), "Product_Code", "Product_Description")
        .limit(n)
        .withColumn("Category", category_of(F.col("Product_Code"), catalog))
    )


def product_counts(lines: DataFrame) -> DataFrame:
    """Line items per canonical product."""
    return lines.groupBy("Product_Code", "Product_Description", "Category").agg(
        _count().alias("line_items")
    )


def segment_of(order_count: Column) -> Column:
    """Loyalty label for a number of orders."""
    *bounded, (last, _) = SEGMENTS
    label = F.lit(last)
    for name, most in reversed(bounded):
        label = F.when(order_count <= most, F.lit(name)).otherwise(label)
    return label


def customer_value(orders: DataFrame) -> DataFrame:
    """Orders, spend and loyalty segment of each member.

    ``orders`` holds one row an order, so a count is the distinct count.
    """
    return (
        orders.groupBy("Customer_Name")
        .agg(_count().alias("orders"), _total("Total_Amount").alias("spent"))
        .withColumn("Type", segment_of(F.col("orders")))
    )


def loyalty_kpis(customers: DataFrame) -> DataFrame:
    """Repeat-buyer rate in percent, mean orders, members with four or more."""
    n = F.col("orders")
    return customers.agg(
        (F.avg((n > 1).cast("double")) * 100).alias("repeat_rate"),
        F.avg(n.cast("double")).alias("mean_orders"),
        F.count(F.when(n >= LOYAL_FROM, 1)).alias("members_4_plus"),
    )


def loyalty_segments(customers: DataFrame) -> DataFrame:
    """Members in each of the four segments; an empty segment shows 0."""
    counts = customers.agg(
        *[F.count(F.when(F.col("Type") == name, 1)).alias(name) for name, _ in SEGMENTS]
    )
    return counts.unpivot([], [f"`{name}`" for name, _ in SEGMENTS], "Segment", "Members")


def orders_by_state(orders: DataFrame) -> DataFrame:
    """Orders per two-letter state."""
    return (
        orders.filter(F.length("Shipping_State") == 2)
        .groupBy("Shipping_State")
        .agg(_count().alias("Orders"))
    )


def summary_stats(lines: DataFrame, date_formats: tuple[str, ...] = ("M/d/yyyy",)) -> DataFrame:
    """Record, order and customer counts and the date range, in one row.

    The range is given over the parsed dates, and over the text as stored. Each
    figure is aggregated by hash to its different values first; only those, few
    beside the lines, are parsed and compared as text.
    """
    dates = lines.groupBy("Date").agg(_count().alias("n")).withColumn("day", to_date(F.col("Date"), date_formats))
    ranges = dates.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        F.min("day").alias("earliest"),
        F.max("day").alias("latest"),
        F.min("Date").alias("earliest_text"),
        F.max("Date").alias("latest_text"),
    )
    order = lines.select(F.nullif("Order_Number", F.lit("")).alias("v")).distinct()
    customer = lines.select(F.col("Customer_Name").alias("v")).distinct()
    parts = [
        ranges,
        order.agg(F.count("v").alias("unique_orders")),
        customer.agg(F.count("v").alias("unique_customers")),
    ]
    # One row each; a maximum puts them side by side.
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    columns = ["total_records", "unique_orders", "unique_customers", *ranges.columns[1:]]
    return rows.agg(*[F.max(c).alias(c) for c in columns])


def summary_top_products(lines: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most frequent product codes; ties by code."""
    return (
        lines.groupBy("Product_Code")
        .agg(_count().alias("records"))
        .orderBy(F.desc("records"), "Product_Code")
        .limit(n)
    )


def summary_sources(lines: DataFrame) -> DataFrame:
    """Records per source file, most first."""
    return (
        lines.groupBy("Source_File")
        .agg(_count().alias("records"))
        .orderBy(F.desc("records"), "Source_File")
    )
