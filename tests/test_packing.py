"""Rows as one text each: nothing is lost, and a shuffle of them is smaller."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlake.operators.packing import PACKED, packed_rows
from orderlake.plans import anonymize, extract
from orderlake.schema import INGEST_KEY
from orderlake.sources import csv_lines
from orderlake.sources.record_store import RecordStore


def test_packed_rows_come_back_as_they_were(spark):
    odd = ["", " ", None, "\x1e", "\x1f", "\x1en", "\x1es\x1f", "\x1ee\x1e", "a\x1f\x1f", "né\n,\"\\", "\x1ese\x1es"]
    rows = [(i, a, b, None if i % 3 else float(i)) for i, (a, b) in enumerate((a, b) for a in odd for b in odd)]
    df = spark.createDataFrame(rows, "n int, first string, last string, x double")
    packed, unpack, cell = packed_rows(df)
    assert packed.columns == ["n", "x", PACKED]
    back = unpack(packed.withColumn("late", F.lit(1)).repartition(3, "n"))
    assert back.columns == [*df.columns, "late"]
    assert sorted(map(str, back.drop("late").collect())) == sorted(map(str, df.collect()))
    assert packed.where(~cell("last").eqNullSafe(F.lit("\x1es\x1f"))).count() == len(rows) - len(odd)
    apart, unpack, _ = packed_rows(df, "last")
    assert apart.columns == ["n", "last", "x", PACKED] and apart.where("last IS NULL").count() == len(odd)
    assert sorted(map(str, unpack(apart).collect())) == sorted(map(str, df.collect()))


def test_one_text_and_none(spark):
    for schema, row in (("a string", (None,)), ("a string", ("",)), ("n int", (1,))):
        df = spark.createDataFrame([row], schema)
        packed, unpack, _ = packed_rows(df)
        assert list(map(tuple, unpack(packed).collect())) == [row]


LINES = f"{INGEST_KEY} string, Order_Number string, Customer_Name string, Email string"
ROWS = [("a", "1.0", "Ann", ""), ("b", "2", "\x1f", "\x1e"), (None, "3", " ann ", None)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_store_deals_and_finds_packed_lines(spark, folder, monkeypatch):
    plans, write = [], RecordStore._write
    monkeypatch.setattr(RecordStore, "_write", lambda self, records, *how: (plans.append(plan_of(records)), write(self, records, *how))[1])
    store = RecordStore(spark, folder, buckets=2)
    assert store.rebuild(spark.createDataFrame(ROWS, LINES)) == 3
    assert "_packed" in plans[0].split("Exchange")[-1]
    assert store.append(spark.createDataFrame([*ROWS, ("c", "4", "\x1en", "\x1f\x1e")], LINES)) == 2
    assert "_packed" in plans[1].split("Exchange")[-1]
    stored = store.records()
    found = store.get(stored.select("id").union(stored.select("id")))
    assert "_packed" in plan_of(found)
    both = [sorted(map(str, df.where(f"{INGEST_KEY} IS NOT NULL").collect())) for df in (found, stored)]
    assert both[0] == both[1] and found.columns == stored.columns and found.count() == 3
    assert {r["customer_name"]: r["email"] for r in found.collect()} == {"Ann": "", "\x1f": "\x1e", "\x1en": "\x1f\x1e"}


def test_lines_meet_identities_packed(spark):
    lines = spark.createDataFrame(ROWS, LINES)
    identities = spark.createDataFrame([("ann", "Bo", "b@o", "1 St"), ("", "Cy", "c@y", "2 St")],
                                       "cust_key string, fake_name string, fake_email string, fake_line1 string")
    made = anonymize.apply_identities(lines, identities)
    assert "_packed" in plan_of(made)
    assert {(r[INGEST_KEY], r["Customer_Name"], r["Email"]) for r in made.collect()} == {
        ("a", "Bo", ""), ("b", "Cy", "\x1e"), (None, "Bo", "")}


def test_lines_are_sorted_packed_for_csv(spark, folder, monkeypatch):
    seen = []
    monkeypatch.setattr(csv_lines, "packed_rows", lambda *a: (seen.append(a[1:]), packed_rows(*a))[1], raising=False)
    csv_lines.write_order_lines(spark.createDataFrame(ROWS, LINES).repartition(3), folder)
    assert seen == [(INGEST_KEY,)]
    back = csv_lines.read_order_lines(spark, folder).orderBy(INGEST_KEY).collect()
    assert [(r["Order_Number"], r["Customer_Name"], r["Email"]) for r in back] == [
        ("3", " ann ", ""), ("1.0", "Ann", ""), ("2", "\x1f", "\x1e")]


def test_records_meet_verifications_packed(spark):
    record = {c: None for c in extract.EXTRACTED_COLUMNS} | {"Customer_Name": "\x1fAnn", "Email": "a@b.c", "Quantity": "\x1e"}
    row = {"path": "p", "page_index": 0, "line_no": 0, "Source_File": "f", "may_verify": True, **record}
    names = ", ".join(f"{c} {'boolean' if c == 'may_verify' else 'int' if isinstance(v, int) else 'string'}" for c, v in row.items())
    records = spark.createDataFrame([tuple(row.values()), tuple({**row, "line_no": None}.values())], names)
    answers = spark.createDataFrame([("p", 0, 0, '{"Email": "X@Y.Z"}')], "path string, page_index int, line_no int, response string")
    merged = extract.merge_verifications(records, answers)
    assert "_packed" in plan_of(merged)
    found = {r["line_no"]: r for r in merged.collect()}
    assert found[0].asDict() == {**row, "Email": "X@Y.Z"} and found[None].asDict() == {**row, "line_no": None}
