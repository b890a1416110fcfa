"""Reports from tables brought up to date, against reports over all lines."""

import pytest
from pyspark.sql import functions as F

from orderlake import fixtures as fx
from orderlake.operators.orders import order_level
from orderlake.operators.typed import silver_lines
from orderlake.plans import refresh, reports
from orderlake.plans.tables import all_reports
from orderlake.schema import INGEST_KEY
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("refresh") / "lines")
    silver_lines(fx.raw_names(spark, SF_DIR)).write.parquet(path)
    return spark.read.parquet(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_refresh_equals_the_full_build(spark, lines, folder):
    # Parts by a hash of the line, so that later parts hold the first lines of many orders.
    part = F.pmod(F.xxhash64(INGEST_KEY), F.lit(3))
    state = refresh.write_state(refresh.state_of(lines.where(part == 2)), f"{folder}/0")
    for n in (1, 0):
        state = refresh.refresh(state, lines.where(part == n), f"{folder}/{n + 1}")
    got, want = refresh.state_reports(state), all_reports(lines, order_level(lines))
    for name in got.keys() & want.keys():
        assert got[name].columns == want[name].columns, name
        assert rows(got[name]) == rows(want[name]), name
    assert len(got.keys() & want.keys()) == 10


def test_members_of_a_month(spark, lines, folder):
    state = refresh.write_state(refresh.state_of(lines), folder)
    exact = lines.where("Date_parsed IS NOT NULL").groupBy(reports.month_of(F.col("Date_parsed")).alias("Month")).agg(
        F.countDistinct("Customer_Name").alias("exact")
    )
    both = refresh.members_by_month(state).join(exact, "Month").collect()
    assert len(both) > 50 and all(abs(r.members - r.exact) <= max(1, 0.05 * r.exact) for r in both)


def test_plan_reads_no_old_line(spark, lines, folder):
    lines.limit(50).write.parquet(f"{folder}/old")
    lines.limit(70).write.parquet(f"{folder}/new")
    refresh.write_state(refresh.state_of(spark.read.parquet(f"{folder}/old")), f"{folder}/state")
    tables = refresh.merged(refresh.read_state(spark, f"{folder}/state"), refresh.state_of(spark.read.parquet(f"{folder}/new")))
    for table in tables.values():
        read = table.inputFiles()
        assert any(f"{folder}/new" in f for f in read) and not any(f"{folder}/old" in f for f in read)


def test_refresh_of_nothing(spark, lines, folder):
    none = refresh.write_state(refresh.state_of(lines.limit(0)), f"{folder}/0")
    assert refresh.kpis(none).first().asDict() == {"orders": 0, "line_items": 0, "members": 0, "revenue": 0.0}
    state = refresh.refresh(none, lines, f"{folder}/1")
    again = refresh.refresh(state, lines.limit(0), f"{folder}/2")
    assert rows(again["orders"]) == rows(state["orders"]) and rows(again["products"]) == rows(state["products"])
