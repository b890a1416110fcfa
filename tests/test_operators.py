import pytest
from pyspark.sql import functions as F

from orderlake.operators import filters, mutate, orders, projection, search, topk, typed, vector
from orderlake.plans import reports
from orderlake.schema import INGEST_KEY, ORDER_LINE_COLUMNS


@pytest.fixture
def lines(spark):
    def make(*rows):
        data = [
            {INGEST_KEY: f"{i:04d}", **{c: "" for c in ORDER_LINE_COLUMNS}, **row}
            for i, row in enumerate(rows)
        ]
        schema = ", ".join(f"{c} string" for c in [INGEST_KEY, *ORDER_LINE_COLUMNS])
        return spark.createDataFrame(
            [tuple(d[c] for c in [INGEST_KEY, *ORDER_LINE_COLUMNS]) for d in data], schema
        )

    return make


def keys(df):
    return [r[INGEST_KEY] for r in df.collect()]


def test_first_line_decides_even_if_its_amount_is_missing(lines):
    df = typed.typed_lines(lines(
        {"Order_Number": "1.0", "Total_Amount": "$9"},
        {"Order_Number": "1", "Total_Amount": "9"},
        {"Order_Number": "", "Total_Amount": "5"},
        {"Order_Number": "2", "Total_Amount": "7"},
    ))
    first = orders.order_level(df)
    assert sorted(keys(first)) == ["0000", "0003"]
    row = reports.kpis(df, first).first()
    assert (row["orders"], row["line_items"], row["members"], row["revenue"]) == (2, 4, 1, 7.0)


def test_empty_input(lines):
    none = typed.silver_lines(lines({}).limit(0))
    first = orders.order_level(none)
    assert reports.kpis(none, first).first()["revenue"] == 0.0
    assert reports.summary_stats(none).first()["total_records"] == 0
    members = reports.customer_value(first)
    segments = {r["Segment"]: r["Members"] for r in reports.loyalty_segments(members).collect()}
    assert segments == {"One-time": 0, "Repeat (2-3)": 0, "Loyal (4-6)": 0, "VIP (7+)": 0}
    assert search.search_ranked(none.withColumn("Quantity", F.lit("")), "x").columns


def test_segments(column):
    got = column([(n,) for n in (1, 2, 3, 4, 6, 7)], lambda df: reports.segment_of(F.col("c")), "c int")
    assert got == ["One-time", "Repeat (2-3)", "Repeat (2-3)", "Loyal (4-6)", "Loyal (4-6)", "VIP (7+)"]


def test_month_without_amounts_is_zero(lines):
    df = typed.typed_lines(lines({"Order_Number": "1", "Date": "4/25/2024", "Total_Amount": "?"}))
    assert reports.revenue_by_month(orders.order_level(df)).first()["revenue"] == 0.0


def test_sample_order_totals(lines):
    base = {"Order_Number": "4821", "Service_Fee": "7.26", "Shipping": "12.00", "Total_Amount": "140.25"}
    other = {"Order_Number": "4907", "Service_Fee": "10.94", "Shipping": "12.00", "Total_Amount": "1"}
    df = lines(
        {**base, "Quantity": "1", "Unit_Price": "64.99"}, {**base, "Quantity": "2", "Unit_Price": "28.00"},
        {**other, "Quantity": "1", "Unit_Price": "149.99"}, {**other, "Quantity": "1", "Unit_Price": "39.00"},
    )
    got = {r["Order_Number"]: r for r in orders.order_totals(df).collect()}
    assert [str(got["4821"][c]) for c in ("subtotal", "total")] == ["120.9900", "140.2500"]
    assert [str(got["4907"][c]) for c in ("subtotal", "total")] == ["188.9900", "211.9300"]
    assert got["4821"]["reconciled"] and not got["4907"]["reconciled"]


def test_filters(lines):
    df = lines({"Shipping_State": "OR"}, {"Shipping_State": "TX"}, {"Shipping_State": "OR"})
    assert keys(filters.filter_equality(df, {"Shipping_State": "OR", "Email": None}, 1)) == ["0000"]
    assert len(keys(filters.filter_equality(df))) == 3
    with pytest.raises(ValueError):
        filters.filter_equality(df, {"State": "OR"})


def test_search_tiers(lines):
    df = lines(
        {"Customer_Name": "x12y"}, {"Order_Number": "312"}, {"Order_Number": "a12"},
        {"Order_Number": "12"}, {"Email": "a@b.c", "Customer_Name": "axb"}, {"Email": "A@B.C"},
    )
    assert keys(search.search_ranked(df, " 12 ")) == ["0003"]
    assert keys(search.search_ranked(df, "1[2]")) == ["0001", "0002", "0003", "0000"]
    assert keys(search.search_ranked(df, "A12")) == ["0002"]
    assert keys(search.search_ranked(df, "a@b.c")) == ["0004"]
    assert keys(search.search_ranked(df, "a@b.")) == ["0004", "0005"]
    assert keys(search.search_ranked(df, "a.b")) == ["0004", "0005"]
    assert keys(search.search_ranked(df, "a.b", mode="literal")) == []
    assert keys(search.search_ranked(df, "1(", mode="literal")) == []
    with pytest.raises(ValueError):
        search.search_ranked(df, "1(")
    assert keys(search.search_ranked(df, "", 2)) == ["0000", "0001"]
    assert keys(search.search_ranked(df, "1", 2)) == ["0001", "0002"]
    both = search.search_many(df, ["12", "1[2]"], limit=3).orderBy("Query", "Rank")
    assert [(r["Query"], r[INGEST_KEY]) for r in both.collect()] == [
        ("12", "0003"), ("1[2]", "0001"), ("1[2]", "0002"), ("1[2]", "0003")]


@pytest.mark.parametrize("n", [3, 1500])
def test_top_n_of_a_hot_group(spark, n):
    df = spark.range(6000).withColumn("g", F.when(F.col("id") < 5000, 0).otherwise(F.col("id") % 7 + 1))
    got = topk.top_n_per_group(df, ["g"], ["id"], n, "rank")
    hot = got.filter("g = 0").orderBy("rank").collect()
    assert [r["id"] for r in hot] == list(range(n))
    assert got.groupBy("g").count().agg(F.max("count")).first()[0] == n


QUERY = "query_id long, vector array<double>"


def test_vector_topk_against_brute_force(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    data = rng.normal(size=(300, 8))
    data[7] = 0
    data[20:30] = data[20]
    queries = {1: rng.normal(size=8).tolist(), 2: data[20].tolist()}
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(999, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame(list(queries.items()), QUERY)
    got = vector.vector_topk(df, asked, 5).collect()
    monkeypatch.setattr(vector, "QUERY_BLOCK", 1)
    again = vector.vector_topk(df, asked, 5).collect()
    ranks = lambda rows: sorted((r["query_id"], r["rank"], round(r["score"], 9)) for r in rows)
    assert ranks(again) == ranks(got)
    for q, vec in queries.items():
        norms = np.linalg.norm(data, axis=1)
        score = np.where(norms > 0, data @ vec / np.where(norms > 0, norms, 1) / np.linalg.norm(vec), -9)
        best = sorted(range(300), key=lambda i: (-round(score[i], 12), i))[:5]
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        if q == 1:
            assert [i for _, i in mine] == best
        else:
            assert {i for _, i in mine} <= set(range(20, 30))
    with pytest.raises(ValueError):
        vector.vector_topk(df, spark.createDataFrame([(1, [0.0] * 8)], QUERY), 5)
    with pytest.raises(ValueError):
        vector.vector_topk(df, asked.where("false"), 5)
    with pytest.raises(Exception, match="differ in length"):
        vector.vector_topk(df, spark.createDataFrame([(1, [1.0] * 7)], QUERY), 5).collect()


def test_updates_collapse(spark):
    records = spark.createDataFrame(
        [("a", "1.0", "old@x.y"), ("b", "2.0", "b@x.y")], "id string, order_number string, email string"
    ).withColumns({"document": F.lit("d"), "updated_at": F.lit(None).cast("timestamp")})
    updates = spark.createDataFrame(
        [("a", "3.0", None, 1), ("a", None, "new@x.y", 2), ("a", "4.0", None, 3), ("z", "9", "z", 1)],
        "id string, Order_Number string, Email string, seq int",
    )
    got = {r["id"]: r for r in mutate.apply_updates(records, updates, "seq").collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["order_number"], got["a"]["email"]) == ("4", "new@x.y")
    assert got["a"]["document"] == "4 new@x.y" and got["a"]["updated_at"] is not None
    assert got["b"]["order_number"] == "2.0" and got["b"]["updated_at"] is None
    with pytest.raises(ValueError):
        mutate.apply_updates(records, updates.withColumnRenamed("Email", "Mail"), "seq")
    with pytest.raises(Exception, match="need a sequence"):
        mutate.apply_updates(records, updates.drop("seq")).collect()
    once = mutate.apply_updates(records, updates.where("seq = 1").drop("seq")).collect()
    assert {r["id"]: r["order_number"] for r in once} == {"a": "3", "b": "2.0"}


def test_conform_twice(lines):
    once = projection.conform(lines({"Email": "a"}).drop("Date"))
    assert once.columns == ORDER_LINE_COLUMNS
    assert projection.conform(once).collect() == once.collect()
    assert once.first()["Date"] == ""


def test_vector_topk_keeps_ties_by_id(spark):
    rows = [(i, [1.0, 0.0]) for i in reversed(range(50))] + [(99, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = vector.vector_topk(df, spark.createDataFrame([(5, [2.0, 0.0])], QUERY), 4).orderBy("rank").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [
        (1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0)]


@pytest.mark.parametrize("width", [1, 32, 128])
def test_centroids_of_any_length(spark, width):
    rows = [(1, 1, [1.0] * width), (2, 2, [3.0] * width), (3, 2, [5.0] * (width - 1) + [7.0]), (4, 2, None)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    means = {r["query_id"]: r["vector"] for r in vector.group_centroids(df).collect()}
    assert means == {1: [1.0] * width, 2: [4.0] * (width - 1) + [5.0]}
    assert vector.vector_topk(df, vector.group_centroids(df), 2).count() == 4
    with pytest.raises(Exception, match="differ in length"):
        vector.group_centroids(df.union(spark.createDataFrame([(9, 2, [1.0] * (width + 1))], df.schema))).collect()
