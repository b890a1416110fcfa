"""Bronze order lines (text) to silver order lines (typed, standardised)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlake.functions.products import (
    DEFAULT_CATALOG,
    Catalog,
    canonical_code,
    canonical_description,
    category_of,
)
from orderlake.functions.text import SCRUBBED, scrub
from orderlake.functions.values import clean_order_number, to_date, to_money, to_number
from orderlake.operators.scrub import scrub_many
from orderlake.schema import MONEY_COLUMNS, ORDER_LINE_COLUMNS

#: Tokens that may be an expression each in the plan.
MAX_EXPRESSIONS = 16


def standardize_products(lines: DataFrame, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """Replace code and description by the canonical ones."""
    code = canonical_code(F.col("Product_Code"), F.col("Product_Description"), catalog)
    return lines.withColumn("Product_Code", code).withColumn(
        "Product_Description", canonical_description(F.col("Product_Code"), catalog)
    )


def scrub_tokens(lines: DataFrame, tokens: Sequence[str], replacement: str = SCRUBBED) -> DataFrame:
    """Replace organisation tokens in every public text column, literally and in order.

    More than ``MAX_EXPRESSIONS`` tokens go through an automaton instead of an
    expression each, with the same outcome.
    """
    if not tokens:
        return lines
    text = [n for n, kind in lines.dtypes if kind == "string" and n in ORDER_LINE_COLUMNS]
    if len(tokens) > MAX_EXPRESSIONS:
        return scrub_many(lines, text, tokens, replacement)
    return lines.withColumns({n: scrub(F.col(n), tokens, replacement) for n in text})


def typed_lines(
    lines: DataFrame,
    date_formats: Sequence[str] = ("M/d/yyyy",),
    catalog: Catalog = DEFAULT_CATALOG,
) -> DataFrame:
    """Cleaned order number, typed amounts and date, category of the code."""
    return lines.withColumns({
        "Order_Number": clean_order_number(F.col("Order_Number")),
        **{c: to_money(F.col(c)) for c in MONEY_COLUMNS},
        "Quantity": to_number(F.col("Quantity")),
        "Date_parsed": to_date(F.col("Date"), date_formats),
        "Category": category_of(F.col("Product_Code"), catalog),
    })


def silver_lines(raw: DataFrame, **options) -> DataFrame:
    """Standardise products, then type; the input of every report."""
    return typed_lines(standardize_products(raw), **options)
