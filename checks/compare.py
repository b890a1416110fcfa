"""Run queries on Spark and DuckDB side by side and compare the whole results.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES
from orderlake.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark: SparkSession, con, sf_dir: str, name: str) -> str | None:
    """None where both engines agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    result = con.execute(ORACLES[name])
    want_columns, want = [d[0] for d in result.description], result.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    if not want:
        return "the oracle has no rows"
    a, b = _bag(got_columns, got), _bag(want_columns, want)
    if a == b:
        return None
    extra, missing = list((a - b).items())[:2], list((b - a).items())[:2]
    return f"{len(got)} rows != {len(want)}; extra {extra}; missing {missing}"


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("checks", "local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in argv[1:] or QUERIES:
        started = time.time()
        try:
            problem = difference(spark, con, sf_dir, name)
        except Exception as error:  # go on to the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok':5}{time.time() - started:7.2f}s  {name}  {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
