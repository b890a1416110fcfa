"""Order lines and page tables derived from a star schema of orders.

The reference inputs are scans and exports nobody can ship, so queries, tests
and the benchmark run on these frames. They hold on purpose the faults real
exports have: blanks, stray suffixes, misspelt codes, unreadable amounts. Each
expression is plain SQL that other engines read the same way.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlake.functions.text import base_name
from orderlake.schema import EXTRACTED_COLUMNS, INGEST_KEY, VERIFIED_COLUMNS

ORDER_LINE_SQL = {
    "Ingest_Key": "concat(lpad(cast(l_orderkey as string),10,'0'),'-',"
                  "lpad(cast(l_linenumber as string),3,'0'),'-',"
                  "lpad(cast(l_partkey as string),10,'0'),'-',"
                  "lpad(cast(l_suppkey as string),10,'0'),'-',"
                  "cast(cast(l_shipdate as date) as string))",
    "Order_Number": "case when l_orderkey % 97 = 0 then '' "
                    "when l_orderkey % 7 = 0 then concat(cast(l_orderkey as string),'.0') "
                    "else cast(l_orderkey as string) end",
    "Date": "case when l_orderkey % 53 = 0 then '' when l_orderkey % 59 = 0 then 'illegible' "
            "else concat(cast(month(o_orderdate) as string),'/',cast(day(o_orderdate) as string),"
            "'/',cast(year(o_orderdate) as string)) end",
    "Customer_Name": "c_name",
    "Email": "case when c_custkey % 11 = 0 then '' "
             "else concat(lower(replace(c_name,'#','.')),'@example.com') end",
    "Ship_Date": "concat(cast(month(l_shipdate) as string),'/',cast(day(l_shipdate) as string),"
                 "'/',cast(year(l_shipdate) as string))",
    "Shipping_Address_Line1": "concat(cast(100 + c_custkey % 9800 as string),' ',c_mktsegment,' St')",
    "Shipping_Address_Line2": "case when c_custkey % 3 = 0 "
                              "then concat('Apt ',cast(c_custkey % 40 as string)) else '' end",
    "Shipping_City": "concat('City ',cast(c_nationkey as string))",
    "Shipping_State": "case when c_nationkey % 10 = 9 "
                      "then concat('NATION_',cast(c_nationkey as string)) "
                      "else substr('ALAKAZARCACOCTDEFLGAHIIDILINIAKSKYLAMEMDMAMIMNMSMO',"
                      " cast(1 + 2*c_nationkey as int), 2) end",
    "Shipping_Zip": "concat(lpad(cast((c_custkey * 37) % 100000 as string),5,'0'), "
                    "case when c_custkey % 4 = 0 then '-1234' else '' end)",
    "Product_Code": "case p_partkey % 12 when 0 then 'CARM-5' when 1 then 'CARA-3' "
                    "when 2 then 'CRAV1' when 3 then 'GUMMIE-3' when 4 then 'GLM 5' "
                    "when 5 then 'MG-10' when 6 then 'CHOCH-1' when 7 then 'HBAR-2-5' "
                    "when 8 then 'SMPL' when 9 then 'SIMPLER-3' when 10 then '' else 'XYZ-3' end",
    "Product_Description": "p_name",
    "Unit_Price": "cast(cast(p_retailprice as decimal(12,2)) as string)",
    "Quantity": "cast(cast(l_quantity as int) as string)",
    "Extended_Price": "cast(cast(l_extendedprice as decimal(14,2)) as string)",
    "Service_Fee": "'8.58'",
    "Total_Discount": "cast(cast(-1 * l_discount * 100 as decimal(12,2)) as string)",
    "Sub_Total": "cast(cast(o_totalprice - 12 as decimal(14,2)) as string)",
    "Shipping": "'12.00'",
    "Total_Amount": "case when l_orderkey % 61 = 0 "
                    "then concat('$',cast(cast(o_totalprice as decimal(14,2)) as string)) "
                    "else cast(cast(o_totalprice as decimal(14,2)) as string) end",
    "Source_File": "concat('ACME - scan_',cast(l_orderkey % 40 as string),'.pdf')",
    "Source_Page": "cast(l_linenumber as string)",
}

# The same lines with the customer's name spelt unevenly, and blank for some.
# An address line with line breaks, quotes and commas, on the second line of an order.
BROKEN_LINE_SQL = (
    "case when Source_Page = '2' then concat(Shipping_Address_Line2, chr(10), 'c/o ', chr(34), Customer_Name, chr(34), "
    "',', chr(10), chr(10), 'rear') else Shipping_Address_Line2 end"
)

UNEVEN_NAME_SQL = (
    "case when c_custkey % 101 = 0 then '' "
    "when l_orderkey % 5 = 0 then concat('  ', upper(c_name), ' ') else c_name end"
)

# How each slip of the page table is made, by order key.
# Scanners number their files anew in each folder, so base names repeat.
PAGE_PATH_SQL = "concat('inbox/', Ingest_Key, '/scan_', cast(l_orderkey % 40 as string), '.pdf')"
NO_IMAGE, PROSE, EMPTY_ARRAY = "l_orderkey % 41 = 0", "l_orderkey % 43 = 0", "l_orderkey % 47 = 0"


# Partitions that a trial run spreads the large tables over; None leaves them as they lie.
SPREAD: int | None = None


def table(spark: SparkSession, sf_dir: str, name: str, *spread: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(SPREAD, *spread) if SPREAD and spread else df


def _joined(spark: SparkSession, sf_dir: str, made: dict[str, str], *extra: str) -> DataFrame:
    """The columns ``made`` by SQL, and ``extra`` ones of the lines.

    What an order or a part says is worked out once for it, before lines meet it, and not again for every line; so no
    stage has all the expressions in one method, which the JVM would not compile. Lines meet their part while they are
    narrow; the customer comes along with the order.
    """
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    parts = table(spark, sf_dir, "part")
    placed = orders.join(customers, orders.o_custkey == customers.c_custkey).withColumn("l_orderkey", F.col("o_orderkey"))
    by_part = [n for n, sql in made.items() if _tables_of(sql) == {"p"}]
    # A line's order key is that of its order; what follows from the key alone need not be shuffled.
    by_order = [n for n, sql in made.items() if _tables_of(sql) & {"o", "c"} and _tables_of(sql.replace("l_orderkey", "o_")) <= {"o", "c"}]
    placed = placed.select("o_orderkey", *[F.expr(made[n]).alias(n) for n in by_order])
    parts = parts.select("p_partkey", *[F.expr(made[n]).alias(n) for n in by_part])
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey).join(placed, lines.l_orderkey == placed.o_orderkey)
    ready = {*by_part, *by_order}
    return joined.select(*[F.col(n) if n in ready else F.expr(sql).alias(n) for n, sql in made.items()], *extra)


def _tables_of(sql: str) -> set[str]:
    """The first letters of the tables that an expression names columns of."""
    return set(re.findall(r"\b([locp])_", re.sub(r"'[^']*'", "", sql)))


def order_lines_raw(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """The 22 text columns and the ingest key; ``extra`` adds columns of the lines."""
    return _joined(spark, sf_dir, ORDER_LINE_SQL, *extra)


def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir, {**ORDER_LINE_SQL, "Customer_Name": UNEVEN_NAME_SQL})


def _slip(columns: list[str], *last):
    """A slip with one ``Label: value`` line per column; NULL lines are left out."""
    lines = [F.concat(F.lit(c.replace("_", " ") + ": "), F.col(c)) for c in columns]
    return F.concat_ws("\n", F.lit("Packing slip"), *lines, *last)


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slip per order line, and every document as a page of its own.

    Of the slips a third carries its full text, a third too little of it and a
    third two keywords with filler, half of them with an email; those without
    enough text are read from the image. Some images are missing, and some
    slips make a reader answer with prose or an empty array.
    """
    lines = order_lines_raw(spark, sf_dir, "l_orderkey", "l_linenumber")
    answer = (
        F.when(F.expr(PROSE), F.lit("Answer: Sorry, I cannot read this order."))
        .when(F.expr(EMPTY_ARRAY), F.lit("Answer: []"))
    )
    lines = lines.withColumn("slip", _slip(EXTRACTED_COLUMNS, answer))
    filler = F.concat(
        F.lit("order for customer, see the attached sheet for everything else "),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("or write to desk@example.com"))
        .otherwise(F.lit("or ask at the desk")),
    )
    kind = F.col("l_orderkey") % 3
    slips = lines.select(
        F.expr(PAGE_PATH_SQL).alias("path"),
        (F.col("l_linenumber") - 1).cast("int").alias("page_index"),
        F.when(kind == 0, F.col("slip"))
        .when(kind == 1, F.concat(F.lit(" order "), F.col("Order_Number")))
        .otherwise(filler)
        .alias("text"),
        F.when(~F.expr(NO_IMAGE), F.encode("slip", "utf-8")).alias("content"),
    )
    documents = table(spark, sf_dir, "documents", "doc_id").select(
        F.concat(F.lit("inbox/documents/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.lit(0).alias("page_index"),
        "text",
        F.lit(None).cast("binary").alias("content"),
    )
    return slips.unionByName(documents)


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in the state after reading, one per order line, with planted faults.

    Most responses hold the line twice, the second time with an extra note; the
    others are fenced, lone, trailed by text, empty, mixed or prose.
    """
    lines = order_lines_raw(spark, sf_dir, "l_orderkey", "l_linenumber")
    record = F.to_json(F.struct(*EXTRACTED_COLUMNS))
    bare = F.to_json(F.struct("Order_Number", "Customer_Name", F.lit(2).alias("Quantity")))
    plant = F.col("l_orderkey") % 20
    response = (
        F.when(plant == 1, F.concat(F.lit("```json\n["), record, F.lit("]\n```")))
        .when(plant == 2, record)
        .when(plant == 3, F.concat(F.lit("["), record, F.lit("] Hope this helps.")))
        .when(plant == 4, F.lit("[]"))
        .when(plant == 5, F.concat(F.lit("["), record, F.lit(", 7]")))
        .when(plant == 6, F.lit("I cannot read this page."))
        .when(plant == 7, F.concat(F.lit(" \n["), bare, F.lit("]\n")))
        .otherwise(F.concat(F.lit("["), record, F.lit(", "), bare, F.lit("]")))
    )
    return lines.select(
        F.expr(PAGE_PATH_SQL).alias("path"),
        (F.col("l_linenumber") - 1).cast("int").alias("page_index"),
        base_name(F.expr(PAGE_PATH_SQL)).alias("Source_File"),
        "Source_Page",
        F.lit("image").alias("route"),
        F.lit(None).cast("string").alias("error"),
        response.alias("response"),
    )


def verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verification response for each first line, with planted faults."""
    lines = order_lines_raw(spark, sf_dir, "l_orderkey", "l_partkey", "l_linenumber")
    plant = F.col("l_partkey") % 7
    name = (
        F.when(plant == 0, F.lit("X"))
        .when(plant == 1, F.repeat(F.lit("N"), 51))
        .otherwise(F.upper("Customer_Name"))
    )
    fields = {
        "Customer_Name": name,
        "Email": F.when(plant == 2, F.lit("nobody.example.com")).otherwise(F.upper("Email")),
        "Shipping_City": F.when(plant == 3, F.lit("")).otherwise(F.upper("Shipping_City")),
        "Shipping_Zip": F.substring("Shipping_Zip", 1, 5),
    }
    answer = F.to_json(F.struct(*[fields.get(c, F.col(c)).alias(c) for c in VERIFIED_COLUMNS]))
    response = (
        F.when(plant == 4, F.concat(F.lit("Here is the result: "), answer, F.lit(" Done.")))
        .when(plant == 5, F.lit("no object here"))
        .otherwise(answer)
    )
    return lines.select(
        F.expr(PAGE_PATH_SQL).alias("path"),
        (F.col("l_linenumber") - 1).cast("int").alias("page_index"),
        F.lit(0).alias("line_no"),
        response.alias("response"),
    )


def record_ids(lines: DataFrame) -> DataFrame:
    return lines.select(F.sha2(INGEST_KEY, 256).alias("id"))
