"""Reports that follow from small tables, which appended lines bring up to date.

Each table is an aggregate of lines that can be merged: the first line of each order, counts by
product, member, source and date, and a sketch of each month's members. A refresh
aggregates the appended lines alone and merges the result with the tables as they were, so no
old line is read again, whatever its order: a line that comes late but is the first of its
order by ingest key takes its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlake.functions.products import DEFAULT_CATALOG, Catalog, category_of
from orderlake.functions.values import month_of, to_date
from orderlake.operators.orders import order_level
from orderlake.plans import reports
from orderlake.schema import INGEST_KEY

ORDER_COLUMNS = [INGEST_KEY, "Order_Number", "Customer_Name", "Shipping_State", "Date_parsed", "Total_Amount"]
#: A sketch of 2**LOG_SKETCH cells; its relative standard error is about 1.6 %.
LOG_SKETCH = 12

_COUNTS = {
    "products": ["Product_Code", "Product_Description", "Category"],
    "members": ["Customer_Name"],
    "sources": ["Source_File"],
    "dates": ["Date"],
}


def state_of(lines: DataFrame) -> dict[str, DataFrame]:
    """The tables of typed lines (``typed_lines``), best a written table: each is a pass over them. Lines without a number are in no order and in all counts."""
    tables = {"orders": order_level(lines.select(ORDER_COLUMNS))}
    for name, keys in _COUNTS.items():
        tables[name] = lines.groupBy(keys).agg(F.count(F.lit(1)).alias("n"), F.count("Order_Number").alias("numbered"))
    dated = lines.where(F.col("Date_parsed").isNotNull())
    tables["months"] = dated.groupBy(month_of(F.col("Date_parsed")).alias("Month")).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("Customer_Name", F.lit(LOG_SKETCH)).alias("members")
    )
    return tables


def merged(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of all lines from those of two disjoint parts of them."""
    both = {name: old[name].unionByName(new[name]) for name in old}
    tables = {"orders": order_level(both["orders"])}
    for name, keys in _COUNTS.items():
        tables[name] = both[name].groupBy(keys).agg(F.sum("n").alias("n"), F.sum("numbered").alias("numbered"))
    tables["months"] = both["months"].groupBy("Month").agg(
        F.sum("n").alias("n"), F.hll_union_agg("members", F.lit(False)).alias("members")
    )
    return tables


def write_state(state: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """The tables written under ``path`` and read back."""
    for name, table in state.items():
        table.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{name}")
    return read_state(next(iter(state.values())).sparkSession, path)


def read_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in ("orders", *_COUNTS, "months")}


def refresh(state: dict[str, DataFrame], appended: DataFrame, path: str) -> dict[str, DataFrame]:
    """The tables with appended typed lines, written under a path of their own; the old ones stay as they are."""
    return write_state(merged(state, state_of(appended)), path)


def _total(counts: DataFrame, name: str) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))


def _side_by_side(*rows: DataFrame) -> DataFrame:
    """Frames of one row each as one row."""
    names = [c for row in rows for c in row.columns]
    both = rows[0]
    for row in rows[1:]:
        both = both.unionByName(row, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in names))


def kpis(state: dict[str, DataFrame]) -> DataFrame:
    members = state["members"].agg(F.count("Customer_Name").alias("members"))
    revenue = F.coalesce(F.sum("Total_Amount").cast("double"), F.lit(0.0)).alias("revenue")
    by_order = state["orders"].agg(F.count(F.lit(1)).alias("orders"), revenue)
    return _side_by_side(by_order, _total(state["members"], "line_items"), members).select(
        "orders", "line_items", "members", "revenue"
    )


def category_mix(state: dict[str, DataFrame]) -> DataFrame:
    counts = state["products"].groupBy("Category").agg(F.sum("numbered").alias("line_items"))
    return counts.orderBy(F.desc("line_items"), "Category")


def top_products(state: dict[str, DataFrame], n: int = 8, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    counts = state["products"].groupBy("Product_Code", "Product_Description").agg(F.sum("n").alias("line_items"))
    first = counts.orderBy(F.desc("line_items"), "Product_Code", "Product_Description").limit(n)
    return first.withColumn("Category", category_of(F.col("Product_Code"), catalog))


def summary_stats(state: dict[str, DataFrame], date_formats: tuple[str, ...] = ("M/d/yyyy",)) -> DataFrame:
    dates = state["dates"].withColumn("day", to_date(F.col("Date"), date_formats))
    ranges = dates.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        F.min("day").alias("earliest"),
        F.max("day").alias("latest"),
        F.min("Date").alias("earliest_text"),
        F.max("Date").alias("latest_text"),
    )
    row = _side_by_side(
        ranges,
        state["orders"].agg(F.count("Order_Number").alias("unique_orders")),
        state["members"].agg(F.count("Customer_Name").alias("unique_customers")),
    )
    return row.select("total_records", "unique_orders", "unique_customers", *ranges.columns[1:])


def summary_sources(state: dict[str, DataFrame]) -> DataFrame:
    return state["sources"].select("Source_File", F.col("n").alias("records")).orderBy(F.desc("records"), "Source_File")


def members_by_month(state: dict[str, DataFrame]) -> DataFrame:
    """Line items of each month and about how many members they are of, from the sketch alone."""
    about = F.hll_sketch_estimate("members").alias("members")
    return state["months"].select("Month", F.col("n").alias("line_items"), about).orderBy("Month")


def state_reports(state: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The dashboard reports as lazy frames, with the figures that ``tables.all_reports`` gives over all lines."""
    value = reports.customer_value(state["orders"])
    return {
        "kpis": kpis(state),
        "category_mix": category_mix(state),
        "revenue_by_month": reports.revenue_by_month(state["orders"]),
        "top_products": top_products(state),
        "customer_value": value,
        "loyalty_kpis": reports.loyalty_kpis(value),
        "loyalty_segments": reports.loyalty_segments(value),
        "orders_by_state": reports.orders_by_state(state["orders"]),
        "summary_stats": summary_stats(state),
        "summary_sources": summary_sources(state),
        "members_by_month": members_by_month(state),
    }
