"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(app_name: str = "orderlake", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs are written for.

    Shuffle partitions are left to the cluster (AQE merges small ones); the
    web UI stays off because these are batch jobs.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Wide projections compile to methods the JVM will not optimise; past
        # this size Spark splits them instead.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder named by ``spark.checkpoint.dir``."""
    base = _setting(spark, "spark.checkpoint.dir")
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{base.rstrip('/')}/orderlake-{purpose}-{uuid.uuid4().hex}"


# Spark drops a shuffle else only when the driver happens to collect its garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Each query that runs within leaves no shuffle files when it ends, so a job of several steps holds those of one.

    A query that runs again within the same frame makes its shuffles anew.
    """
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def _setting(spark: SparkSession, key: str) -> str | None:
    value = spark.sql(f"SET {key}").first()["value"]
    return None if value == "<undefined>" else value
