"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query is
run to completion over all its rows and columns, without collecting them. One
untimed query warms the JVM up first.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from checks.queries import QUERIES
from orderlake import fixtures
from orderlake.session import build_session

HEADLINE = [
    "revenue_by_month", "kpis", "category_mix", "top_products", "customer_value",
    "loyalty_segments", "orders_by_state", "summary_stats", "order_totals", "order_level",
    "typed_lines", "canonical_products", "customer_key", "search_ranked", "search_text",
    "filter_equality", "vector_topk", "csv_roundtrip", "store_rebuild", "store_update",
    "page_routing", "extract_records", "parse_responses", "anonymize_rules", "anonymize_audit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    fixtures.SPREAD = int(cpus)  # the tables are one file of one row group each
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="orderlake-bench-"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    run("conform")
    seconds = {name: run(name) for name in HEADLINE}
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
