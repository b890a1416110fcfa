"""Plans must keep their shape: no cartesian steps, small shuffles, pruned scans."""

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from orderlake.operators.orders import order_level
from orderlake.plans import reports
from tests.conftest import SF_DIR

# These run jobs while they are built; their parts are covered by the others.
EAGER = {"csv_roundtrip", "store_rebuild", "store_append", "store_update", "store_delete",
         "stream_extract", "page_source", "anonymize_rules", "anonymize_audit", "vector_topk"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in EAGER])
def test_no_cartesian_step(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_first_lines_are_picked_before_the_shuffle(spark):
    text = plan(QUERIES["order_level"](spark, SF_DIR))
    assert text.index("WindowGroupLimit") < text.index("Exchange hashpartitioning(Order_Number")
    assert "Partial" in text


def test_top_rows_are_taken_in_place(spark):
    for name in ("scan_limit", "top_products", "summary_top_products", "search_exact_order"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, SF_DIR))


def test_reports_read_only_their_columns(spark, folder):
    from checks.queries import _silver

    _silver(spark, SF_DIR).write.parquet(folder)
    silver = spark.read.parquet(folder)
    mix = plan(reports.category_mix(silver))
    assert "ReadSchema: struct<Order_Number:string,Category:string>" in mix
    months = plan(reports.revenue_by_month(order_level(silver)))
    read = months.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in read.split(",")} >= {"Order_Number", "Date_parsed"}
    assert read.count(":") == 4


def test_a_hot_order_does_not_gather(spark):
    """Half of the lines belong to one order; each task forwards one of them."""
    hot = spark.range(0, 40000, 1, 8).select(
        F.format_string("%06d", "id").alias("Ingest_Key"),
        F.when(F.col("id") % 2 == 0, "1").otherwise(F.col("id").cast("string")).alias("Order_Number"),
    )
    first = order_level(hot)
    assert first.filter("Order_Number = '1'").first()["Ingest_Key"] == "000000"
    assert first.count() == 20000
    assert plan(first).count("WindowGroupLimit") == 2


def test_each_page_is_read_and_checked_once(spark):
    assert plan(QUERIES["extract_records"](spark, SF_DIR)).count("ArrowEvalPython") == 2


def test_a_hot_customer_is_split_in_the_identity_join(spark, folder):
    from orderlake.fixtures import order_lines_raw
    from orderlake.plans.anonymize import apply_identities, customer_key

    raw = order_lines_raw(spark, SF_DIR)
    hot = F.when(F.hash("Ingest_Key") % 3 == 0, F.lit("")).otherwise(F.col("Customer_Name"))
    raw.withColumn("Customer_Name", hot).repartition(6).write.parquet(f"{folder}/lines")
    lines = spark.read.parquet(f"{folder}/lines")
    ids = lines.select(customer_key(F.col("Customer_Name")).alias("cust_key")).distinct().select(
        "cust_key", *[F.col("cust_key").alias(f"fake_{c}") for c in ("name", "email", "line1")])
    ids.write.parquet(f"{folder}/ids")
    ids = spark.read.parquet(f"{folder}/ids")
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in changed.items():
        spark.conf.set(key, value)
    try:
        after = apply_identities(lines, ids)
        assert len(after.collect()) == lines.count()
        assert "skew=true" in plan(after)
    finally:
        for key in changed:
            spark.conf.unset(key)


def test_orders_and_parts_are_worked_out_before_lines_meet_them(spark, tmp_path):
    from orderlake import fixtures as fx

    # Both raw forms over rows with nulls, repeated keys and keys without a partner.
    when = "timestamp '2024-01-31 10:00:00'"
    spark.sql(f"select * from values (1, 10), (1, 11), (7, 10), (null, 10), (5, null), (9, 99) as t(o_orderkey, o_custkey)").selectExpr(
        "cast(o_orderkey as bigint) o_orderkey", "cast(o_custkey as bigint) o_custkey", "12.5D o_totalprice",
        f"if(o_custkey = 11, null, {when}) o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("select * from values (10, 'Customer#10', 3), (11, null, null), (11, 'B', 4) as t(k, n, nat)").selectExpr(
        "cast(k as bigint) c_custkey", "n c_name", "nat c_nationkey", "'AUTO' c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("select * from values (2, 'red ring'), (3, null) as t(k, n)").selectExpr(
        "cast(k as bigint) p_partkey", "n p_name", "9.5D p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("select * from values (1, 2), (1, 3), (7, 2), (7, 2), (null, 2), (5, 2), (1, null), (8, 2) as t(o, p)").selectExpr(
        "cast(o as bigint) l_orderkey", "cast(p as bigint) l_partkey", "4L l_suppkey", "1 l_linenumber", "2.0D l_quantity",
        "19.0D l_extendedprice", "0.1D l_discount", f"{when} l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    lines, orders, customers, parts = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("lineitem", "orders", "customer", "part"))
    plain = lines.join(orders, F.expr("l_orderkey = o_orderkey")).join(customers, F.expr("o_custkey = c_custkey")).join(
        parts, F.expr("l_partkey = p_partkey"))
    for found, names in ((fx.order_lines_raw(spark, str(tmp_path)), {}), (fx.raw_names(spark, str(tmp_path)), {"Customer_Name": fx.UNEVEN_NAME_SQL})):
        wanted = plain.select(*[F.expr(sql).alias(n) for n, sql in {**fx.ORDER_LINE_SQL, **names}.items()])
        assert found.schema == wanted.schema
        assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect())) and wanted.count() == 8
        last = plan(found).split("Join")[0]
        assert "o_orderdate" not in last and "c_mktsegment" not in last and "p_retailprice" not in last
