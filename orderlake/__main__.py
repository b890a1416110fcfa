"""Jobs for spark-submit.

    anonymize IN.csv OUT_DIR PRIVATE_DIR [--scrub TOKENS] [--scrub-file FILE]
    build     IN.csv STORE
    extract   PAGES LOG READER [--parallelism N] [--images PATTERN]
    export    STORE OUT_DIR
    report    STORE TABLES_DIR [NAME ...]
    search    STORE QUERY [--limit N] [--literal] [--out DIR]

READER names an object of the caller's, as ``package.module:NAME``. ``report``
writes each report as a table beside the two it rests on.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys

if not __package__:
    # Run as a script, by spark-submit: the package lies in the folder above.
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orderlake.functions.text import split_tokens  # noqa: E402
from orderlake.operators.projection import browse, rename_to_display  # noqa: E402
from orderlake.plans.anonymize import anonymize  # noqa: E402
from orderlake.plans.extract import run_counters, run_extraction  # noqa: E402
from orderlake.plans.tables import all_reports, build_tables  # noqa: E402
from orderlake.schema import INGEST_KEY  # noqa: E402
from orderlake.session import build_session  # noqa: E402
from orderlake.shipping import ship  # noqa: E402
from orderlake.sources.csv_lines import read_order_lines, write_order_lines  # noqa: E402
from orderlake.sources.pages import read_page_files, read_pages  # noqa: E402
from orderlake.sources.record_store import RecordStore  # noqa: E402


def _displayed(store: RecordStore):
    records = store.records()
    return rename_to_display(records, keep=(INGEST_KEY,))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="orderlake")
    jobs = parser.add_subparsers(dest="job", required=True)
    job = jobs.add_parser("anonymize")
    job.add_argument("source")
    job.add_argument("public")
    job.add_argument("private")
    job.add_argument("--scrub", default="")
    job.add_argument("--scrub-file", help="further tokens, one a line")
    job = jobs.add_parser("build")
    job.add_argument("source")
    job.add_argument("store")
    job = jobs.add_parser("extract")
    job.add_argument("pages")
    job.add_argument("log")
    job.add_argument("reader")
    job.add_argument("--parallelism", type=int)
    job.add_argument("--images", help="the folder holds image files of this pattern")
    job = jobs.add_parser("export")
    job.add_argument("store")
    job.add_argument("public")
    job = jobs.add_parser("report")
    job.add_argument("store")
    job.add_argument("tables")
    job.add_argument("names", nargs="*")
    job = jobs.add_parser("search")
    job.add_argument("store")
    job.add_argument("query")
    job.add_argument("--limit", type=int, default=100)
    job.add_argument("--literal", action="store_true")
    job.add_argument("--out", help="write the records found there, as Parquet, instead of showing them")
    args = parser.parse_args(argv)

    spark = build_session(f"orderlake-{args.job}")
    ship(spark)
    if args.job == "anonymize":
        lines = read_order_lines(spark, args.source)
        tokens = split_tokens(args.scrub)
        if args.scrub_file:
            # A list of settings, as the argument is.
            tokens += [t for row in spark.read.text(args.scrub_file).collect() if (t := row["value"].strip())]
        print(anonymize(lines, args.public, args.private, tokens))
    elif args.job == "build":
        print("records:", RecordStore(spark, args.store).rebuild(read_order_lines(spark, args.source)))
    elif args.job == "extract":
        module, _, name = args.reader.partition(":")
        reader = getattr(importlib.import_module(module), name)
        if args.images:
            pages = read_page_files(spark, args.pages, args.images)
        else:
            pages = read_pages(spark, args.pages)
        log = run_extraction(spark, pages, args.log, reader, args.parallelism)
        for row in run_counters(log).orderBy("route", "status").collect():  # a row an outcome
            print(*(f"{k}: {v}" for k, v in row.asDict().items()), sep=", ")
    elif args.job == "export":
        write_order_lines(_displayed(RecordStore(spark, args.store)), args.public)
    elif args.job == "report":
        lines = _displayed(RecordStore(spark, args.store))
        made = all_reports(*build_tables(lines, args.tables))
        for name in args.names or made:
            path = f"{args.tables.rstrip('/')}/{name}"
            made[name].write.mode("overwrite").parquet(path)
            print(name, "->", path)
    else:
        mode = "literal" if args.literal else "regex"
        found = RecordStore(spark, args.store).search(args.query, args.limit, mode)
        if args.out:
            found.write.mode("overwrite").parquet(args.out)
        else:
            browse(found).show(args.limit, truncate=False)


if __name__ == "__main__":
    main()
