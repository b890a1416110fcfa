import orderlake.__main__ as jobs
from orderlake.schema import ORDER_LINE_COLUMNS
from orderlake.schema import PAGE_SCHEMA
from orderlake.sources.csv_lines import read_order_lines
from orderlake.sources.record_store import RecordStore


def test_from_csv_to_reports(spark, folder, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(jobs, "build_session", lambda _name: spark)
    row = dict.fromkeys(ORDER_LINE_COLUMNS, "")
    orders = [
        {**row, "Order_Number": "12440.0", "Date": "4/25/2024", "Customer_Name": "Ann Real",
         "Email": "ann@real.org", "Product_Code": "GUMMIE-3", "Total_Amount": "10.50",
         "Shipping_State": "OR", "Shipping_Zip": "97214", "Source_File": "Firm scan.pdf"},
        {**row, "Order_Number": "12440", "Date": "4/25/2024", "Customer_Name": "ann real ",
         "Product_Code": "SMPL", "Total_Amount": "10.50", "Shipping_State": "OR"},
    ]
    source = tmp_path / "raw.csv"
    lines = [",".join(ORDER_LINE_COLUMNS)] + [",".join(o.values()) for o in orders]
    source.write_text("\n".join(lines) + "\n")

    jobs.main(["anonymize", str(source), f"{folder}/public", f"{folder}/private", "--scrub", "Firm, ,"])
    jobs.main(["build", f"{folder}/public", f"{folder}/store"])
    stored = RecordStore(spark, f"{folder}/store").records().collect()
    assert {r["order_number"] for r in stored} == {"12440"}
    assert {r["product_code"] for r in stored} == {"GUMM-3", "SAMP"}
    assert {r["source_file"] for r in stored} == {"sample-scan scan.pdf", ""}
    assert "ann" not in " ".join(r["customer_name"] for r in stored).lower().split()

    jobs.main(["report", f"{folder}/store", f"{folder}/tables", "kpis", "orders_by_state"])
    assert "kpis ->" in capsys.readouterr().out
    kpis = spark.read.parquet(f"{folder}/tables/kpis").first()
    assert (kpis["orders"], kpis["line_items"], kpis["members"], float(kpis["revenue"])) == (1, 2, 1, 10.5)
    assert [tuple(r) for r in spark.read.parquet(f"{folder}/tables/orders_by_state").collect()] == [("OR", 1)]
    jobs.main(["export", f"{folder}/store", f"{folder}/exported"])
    assert read_order_lines(spark, f"{folder}/exported").count() == 2
    jobs.main(["search", f"{folder}/store", "gumm", "--literal"])
    shown = capsys.readouterr().out
    assert "GUMM-3" in shown and "SAMP" not in shown


def test_extract_job(spark, folder, monkeypatch, capsys):
    monkeypatch.setattr(jobs, "build_session", lambda _name: spark)
    text = "order customer total product quantity price email date and more words\nOrder Number: 4"
    spark.createDataFrame([("in/a.pdf", 0, text, None)], PAGE_SCHEMA).write.parquet(f"{folder}/pages")
    jobs.main(["extract", f"{folder}/pages", f"{folder}/log", "checks.slip_reader:SLIP_READER"])
    assert "route: text, status: ok, pages: 1, records: 1" in capsys.readouterr().out


def test_reports_are_written_whole(spark, folder):
    """No report is cut: revenue by month has all 80 months."""
    from checks.queries import revenue_by_month
    from tests.conftest import SF_DIR

    revenue_by_month(spark, SF_DIR).write.parquet(f"{folder}/months")
    assert spark.read.parquet(f"{folder}/months").count() == 80
