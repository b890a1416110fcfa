"""What jobs of several steps leave on disk."""

from __future__ import annotations

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from checks.slip_reader import SLIP_READER
from orderlake.operators.projection import conform
from orderlake.operators.search_index import SearchIndex
from orderlake.plans import anonymize, extract
from orderlake.schema import INGEST_KEY
from orderlake.session import freed_shuffles
from orderlake.sources.csv_lines import write_order_lines
from orderlake.sources.record_store import RecordStore, record_id

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffles(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {os.path.basename(f) for d in dirs for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}


def lines_of(spark):
    rows = [(f"k{i:03d}", str(i % 7), f"n{i % 5}", "e@x.y") for i in range(60)]
    return spark.createDataFrame(rows, f"{INGEST_KEY} string, Order_Number string, Customer_Name string, Email string").repartition(3)


def rebuild_update_and_delete(spark, folder):
    store = RecordStore(spark, folder, buckets=2)
    store.rebuild(lines_of(spark))
    assert store.append(lines_of(spark).withColumn(INGEST_KEY, F.concat(F.lit("x"), INGEST_KEY))) == 60
    ids = spark.range(1).select(record_id(F.lit("k001")).alias("id"))
    assert store.update(ids.withColumn("Email", F.lit("z"))) == 1 and store.delete(ids) == 1


def anonymize_lines(spark, folder):
    assert anonymize.anonymize(lines_of(spark), f"{folder}/public", f"{folder}/private")["customers"] == 5


def index_lines(spark, folder):
    SearchIndex(spark, folder, conform(lines_of(spark), keep=(INGEST_KEY,)), buckets=2).build()


def write_lines(spark, folder):
    write_order_lines(lines_of(spark), folder)


def extract_pages(spark, folder):
    pages = spark.createDataFrame([("p", 0, "Packing slip", b"Packing slip\nOrder Number: 1")], "path string, page_index int, text string, content binary")
    extract.run_extraction(spark, pages.repartition(2, "path"), folder, SLIP_READER)
    assert glob.glob(f"{folder}/*.zstd.parquet") and not glob.glob(f"{folder}/*.snappy.parquet")


@pytest.mark.parametrize("job", [rebuild_update_and_delete, anonymize_lines, index_lines, write_lines, extract_pages])
def test_a_job_leaves_no_shuffles(spark, folder, job):
    before, set_before = shuffles(spark), spark.conf.get(FREED)
    job(spark, folder)
    until = time.time() + 10
    while shuffles(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles(spark) - before
    assert spark.conf.get(FREED) == set_before


def test_a_frame_can_be_run_again_when_its_shuffles_are_gone(spark):
    counted = lines_of(spark).groupBy("Customer_Name").count()
    with freed_shuffles(spark), freed_shuffles(spark):
        assert sorted(counted.collect()) == sorted(counted.collect()) and counted.count() == 5
        kept = lines_of(spark).repartition(3, "Email").groupBy("Email").count()
        first = kept.collect()
    assert first == kept.collect() == [("e@x.y", 60)]
    with pytest.raises(ZeroDivisionError), freed_shuffles(spark):
        1 / 0
    assert spark.conf.get(FREED) == "false"
