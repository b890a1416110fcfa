"""Every operator as a query over whole tables."""

from __future__ import annotations

import re
import tempfile
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks.slip_reader import SLIP_READER
from orderlake import fixtures as fx
from orderlake import session
from orderlake.functions.pages import has_sufficient_text
from orderlake.functions.products import category_of
from orderlake.functions.text import blank_if_null, zip_prefix
from orderlake.functions.values import clean_order_number
from orderlake.operators import filters, mutate, orders, projection, search, typed, vector
from orderlake.operators.search_index import SearchIndex
from orderlake.plans import anonymize as anon
from orderlake.plans import audit as audits
from orderlake.plans import extract, refresh, reports
from orderlake.schema import EXTRACTED_COLUMNS, INGEST_KEY, MONEY_COLUMNS, ORDER_LINE_COLUMNS
from orderlake.sources.csv_lines import read_order_lines, write_order_lines
from orderlake.sources.pages import read_pages
from orderlake.sources.record_store import RecordStore, to_records
from orderlake.streaming.ingest import read_log, stream_extraction


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the shared folder; a local one for trial runs of a local session without the setting."""
    try:
        return session.scratch_path(spark, purpose)
    except RuntimeError:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise
        return f"{tempfile.mkdtemp(prefix='orderlake-checks-')}/{purpose}"


SCRUB = ["ACME", "BUILDING"]
MANY_SCRUBBED = ["Customer_Name", "Email", "Product_Code", "Product_Description", "Shipping_City", "Shipping_State"]
SEARCHES = ["12", "ring", "customer.000000007@example.com", "city 1[0-9]"]
SEARCH_LIMIT = 100
INDEXED = [("Ring|CITY 2", "regex"), ("City 1", "literal"), ("al", "literal"), (r"customer[.#]0+7@.*\.com", "regex"), (r"^[a-z]{2}$", "regex")]
BATCH_TEXTS = ["ring", "city 1[0-9]", " Smpl ", "(steel|red) b", "^.?5$", "no such text", "9999999", "nobody@example.com", ""]


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Raw lines with a clean order number, as the record store holds them."""
    raw = fx.order_lines_raw(spark, sf)
    return raw.withColumn("Order_Number", clean_order_number(F.col("Order_Number")))


def _silver(spark: SparkSession, sf: str) -> DataFrame:
    return typed.silver_lines(fx.order_lines_raw(spark, sf))


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return orders.order_level(_silver(spark, sf))


def _as_doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


# Projections and scalar steps


def conform(spark, sf):
    given = fx.order_lines_raw(spark, sf).drop("Service_Fee").withColumn("Reviewer", F.lit("x"))
    return projection.conform(given, keep=(INGEST_KEY,))


def rename_display(spark, sf):
    shown = projection.rename_to_display(to_records(fx.order_lines_raw(spark, sf)))
    return shown.drop("id", "Created_At", "Updated_At")


def browse(spark, sf):
    return projection.browse(_lines(spark, sf))


def search_document(spark, sf):
    lines = fx.order_lines_raw(spark, sf)
    return lines.select(INGEST_KEY, projection.search_document(lines).alias("document"))


def provenance(spark, sf):
    pages = projection.with_provenance(fx.page_table(spark, sf))
    return pages.select("path", "Source_File", "Source_Page")


def scan_limit(spark, sf):
    return filters.scan(_lines(spark, sf), SEARCH_LIMIT)


def typed_lines(spark, sf):
    lines = typed.typed_lines(fx.order_lines_raw(spark, sf))
    return _as_doubles(lines, *MONEY_COLUMNS)


def clean_order_numbers(spark, sf):
    return fx.order_lines_raw(spark, sf).select(
        INGEST_KEY, "Order_Number", clean_order_number(F.col("Order_Number")).alias("clean")
    )


def reclean_count(spark, sf):
    raw = projection.rename_to_stored(fx.order_lines_raw(spark, sf))
    raw = raw.withColumn("updated_at", F.current_timestamp())
    again = mutate.reclean_order_numbers(raw)
    first = mutate.count_unclean(raw).withColumn("run", F.lit("first"))
    return first.unionByName(mutate.count_unclean(again).withColumn("run", F.lit("second")))


def zip_area(spark, sf):
    return fx.order_lines_raw(spark, sf).select(
        INGEST_KEY, zip_prefix(F.col("Shipping_Zip")).alias("zip_area")
    )


def token_scrub(spark, sf):
    return typed.scrub_tokens(fx.order_lines_raw(spark, sf), SCRUB)


def token_scrub_many(spark, sf):
    """The names, words and brands of products, market segments and nations as tokens: lists that do not grow."""
    part = fx.table(spark, sf, "part")
    words = [
        part.select(F.col("p_name").alias("token")),
        part.select(F.explode(F.split("p_name", " ")).alias("token")),
        part.select("p_brand"),
        fx.table(spark, sf, "customer").select("c_mktsegment"),
        fx.table(spark, sf, "nation").select("n_name"),
    ]
    tokens = sorted(row["token"] for row in reduce(DataFrame.union, words).distinct().collect())
    lines = fx.order_lines_raw(spark, sf).select(INGEST_KEY, *MANY_SCRUBBED)
    return typed.scrub_tokens(lines, tokens)


def customer_key(spark, sf):
    name = F.col("Customer_Name")
    return fx.raw_names(spark, sf).groupBy(anon.customer_key(name).alias("cust_key")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.min_by(blank_if_null(name), INGEST_KEY).alias("first_spelling"),
    )


def category(spark, sf):
    raw = fx.order_lines_raw(spark, sf)
    canonical = typed.standardize_products(raw)
    return canonical.select(
        INGEST_KEY, "Product_Code", category_of(F.col("Product_Code")).alias("Category")
    )


# Reports


def canonical_products(spark, sf):
    return reports.product_counts(_silver(spark, sf))


def order_level(spark, sf):
    kept = [INGEST_KEY, "Order_Number", "Customer_Name", "Shipping_State", "Date_parsed", "Total_Amount"]
    return _as_doubles(_orders(spark, sf).select(*kept), "Total_Amount")


def kpis(spark, sf):
    return reports.kpis(_silver(spark, sf), _orders(spark, sf))


def category_mix(spark, sf):
    return reports.category_mix(_silver(spark, sf))


def revenue_by_month(spark, sf):
    return reports.revenue_by_month(_orders(spark, sf))


def top_products(spark, sf):
    return reports.top_products(_silver(spark, sf))


def customer_value(spark, sf):
    return reports.customer_value(_orders(spark, sf))


def loyalty_kpis(spark, sf):
    return reports.loyalty_kpis(reports.customer_value(_orders(spark, sf)))


def loyalty_segments(spark, sf):
    return reports.loyalty_segments(reports.customer_value(_orders(spark, sf)))


def orders_by_state(spark, sf):
    return reports.orders_by_state(_orders(spark, sf))


def summary_stats(spark, sf):
    return reports.summary_stats(_lines(spark, sf))


def summary_top_products(spark, sf):
    return reports.summary_top_products(_lines(spark, sf))


def summary_sources(spark, sf):
    return reports.summary_sources(_lines(spark, sf))


def order_totals(spark, sf):
    return _as_doubles(
        orders.order_totals(_lines(spark, sf)), "subtotal", "total", "stated_total"
    )


def _refreshed(spark, sf):
    """Report tables built from some lines, and brought up to date with the others."""
    path, lines = scratch_path(spark, "state"), _written(spark, "typed", _silver(spark, sf))
    # The lines of an order lie in both parts.
    early = F.pmod(F.xxhash64(INGEST_KEY), F.lit(2)) == 0
    state = refresh.write_state(refresh.state_of(lines.filter(early)), f"{path}/first")
    return refresh.refresh(state, lines.filter(~early), f"{path}/second")


def refresh_kpis(spark, sf):
    return refresh.kpis(_refreshed(spark, sf))


def refresh_customer_value(spark, sf):
    return reports.customer_value(_refreshed(spark, sf)["orders"])


def refresh_summary(spark, sf):
    return refresh.summary_stats(_refreshed(spark, sf))


# Filters and search


def filter_equality(spark, sf):
    wanted = {"Shipping_State": "AZ", "Product_Code": "CARM-5", "Email": ""}
    return filters.filter_equality(_lines(spark, sf), wanted)


def _filled_store(spark, sf) -> RecordStore:
    store = _new_store(spark)
    store.rebuild(fx.order_lines_raw(spark, sf))
    return store


def search_exact_order(spark, sf):
    found = _filled_store(spark, sf).search(" 12 ", SEARCH_LIMIT)
    return found.select(INGEST_KEY, *ORDER_LINE_COLUMNS)


def search_email(spark, sf):
    found = _filled_store(spark, sf).search("customer.000000007@example.com", SEARCH_LIMIT)
    return found.select(INGEST_KEY, *ORDER_LINE_COLUMNS)


def search_text(spark, sf):
    return search.search_text(_lines(spark, sf), "Ring|CITY 2")


def search_literal(spark, sf):
    return search.search_text(_lines(spark, sf), "City 1", mode="literal")


def search_ranked(spark, sf):
    found = search.search_many(_lines(spark, sf), SEARCHES, SEARCH_LIMIT)
    return found.withColumn("Rank", F.col("Rank").cast("bigint"))


def search_indexed(spark, sf):
    """Matches of several patterns and literals through one index; the last has nothing to look up."""
    lines = _written(spark, "indexed", _lines(spark, sf))
    index = SearchIndex(spark, scratch_path(spark, "index"), lines, buckets=16).build()
    found = [index.search_text(q, mode).select(INGEST_KEY, F.lit(q).alias("Query")) for q, mode in INDEXED]
    return reduce(DataFrame.unionByName, found)


def search_batch(spark, sf):
    """Every order number and email of the lines, and some texts, as one table of queries."""
    lines = _written(spark, "batch", _lines(spark, sf))
    index = SearchIndex(spark, scratch_path(spark, "index"), lines, buckets=16).build()
    texts = spark.createDataFrame([(q,) for q in BATCH_TEXTS], "query string")
    asked = texts.union(lines.select("Order_Number")).union(lines.select("Email"))
    found = index.search_table(asked, limit=3)
    return found.select(INGEST_KEY, "Query", F.col("Rank").cast("bigint").alias("Rank"))


def _put(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """A table written for a later step; the shuffles that made it go when it is there."""
    with session.freed_shuffles(df.sparkSession):
        df.write.mode(mode).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _written(spark, purpose, df):
    return _put(df, scratch_path(spark, purpose))


def search_count(spark, sf):
    return search.search_count(_lines(spark, sf), "ring")


def vector_topk(spark, sf):
    vectors = fx.table(spark, sf, "embeddings")
    found = vector.vector_topk(vectors, vector.group_centroids(vectors), k=10)
    return found.withColumn("score", F.round("score", 6))


def vector_topk_many(spark, sf):
    """Every vector as a query, in small tiles: how many neighbours each finds and how near they are."""
    vectors = fx.table(spark, sf, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = vector.vector_tiles(vectors, queries, k=5, tile_rows=2_000, tile_queries=500)
    return found.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("found"),
        F.round(F.min("score"), 5).alias("least"),
        F.round(F.sum("score"), 4).alias("total"),
    )


# Sources, sinks and the record store

_STORED = [INGEST_KEY, "document", *[c.lower() for c in ORDER_LINE_COLUMNS]]


def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    write_order_lines(fx.order_lines_raw(spark, sf), path)
    return read_order_lines(spark, path).select(*ORDER_LINE_COLUMNS)


def csv_split_read(spark, sf):
    """One file with line breaks, quotes and commas inside cells, read by several tasks."""
    path = scratch_path(spark, "split")
    lines = fx.order_lines_raw(spark, sf).withColumn("Shipping_Address_Line2", F.expr(fx.BROKEN_LINE_SQL))
    # Lines are joined by many tasks; the one that writes the file only passes them on.
    write_order_lines(lines.drop(INGEST_KEY).repartition(1), path, max_records_per_file=0)
    return read_order_lines(spark, path).select(*ORDER_LINE_COLUMNS)


def _new_store(spark) -> RecordStore:
    return RecordStore(spark, scratch_path(spark, "store"), buckets=16)


def store_rebuild(spark, sf):
    store = _new_store(spark)
    store.rebuild(fx.order_lines_raw(spark, sf))
    return store.records().select(*_STORED)


def store_append(spark, sf):
    """A first load, then a second one that overlaps it and names its source."""
    store = _new_store(spark)
    raw = fx.order_lines_raw(spark, sf)
    store.append(raw.filter(F.col("Shipping_State") <= "IL"))
    store.append(raw.drop("Source_File"), source_file="late batch.pdf")
    return store.records().select(*_STORED)


def store_update(spark, sf):
    """Unreadable dates become the ship date; ids without a line change nothing."""
    store = _new_store(spark)
    raw = fx.order_lines_raw(spark, sf)
    store.rebuild(raw)
    fixed = raw.filter(F.col("Date") == "illegible").select(
        F.sha2(INGEST_KEY, 256).alias("id"),
        F.col("Ship_Date").alias("Date"),
        F.concat(F.lit("00"), "Order_Number").alias("Order_Number"),
        F.lit(None).cast("string").alias("Email"),
    )
    unknown = raw.filter(F.col("Date") == "").select(
        F.sha2(F.concat(F.lit("unknown "), INGEST_KEY), 256).alias("id"),
        *[F.lit("x").alias(c) for c in ("Date", "Order_Number", "Email")],
    )
    store.update(fixed.unionByName(unknown))
    return store.records().select(*_STORED)


def store_delete(spark, sf):
    """Every line of a customer without an email goes."""
    store = _new_store(spark)
    raw = fx.order_lines_raw(spark, sf)
    store.rebuild(raw)
    store.delete(fx.record_ids(raw.filter(F.col("Email") == "")))
    return store.records().select(*_STORED)


def lookup_by_id(spark, sf):
    """The records of every order's first line, by id; ids without a record give none."""
    ids = fx.record_ids(_orders(spark, sf))
    unknown = ids.select(F.sha2(F.concat(F.lit("unknown "), "id"), 256).alias("id"))
    return _filled_store(spark, sf).get(ids.unionByName(unknown)).select(*_STORED)


def store_reload(spark, sf):
    """CSV files loaded, others put among them, and all of them loaded again."""
    base = scratch_path(spark, "reload")
    store, raw = _new_store(spark), fx.order_lines_raw(spark, sf)
    early = F.col("Shipping_State") <= "IL"
    write_order_lines(raw.filter(early), f"{base}/b", max_records_per_file=7_000)
    store.append(read_order_lines(spark, f"{base}/*"))
    write_order_lines(raw.filter(~early).drop(INGEST_KEY), f"{base}/a", max_records_per_file=500_000)
    store.append(read_order_lines(spark, f"{base}/*"))
    store.append(read_order_lines(spark, f"{base}/*"))
    return store.records().select(*_STORED[1:])


def import_counters(spark, sf):
    """What the jobs report: records of a rebuild, of an append that overlaps it, lines and customers anonymised."""
    store, raw = _new_store(spark), fx.order_lines_raw(spark, sf)
    path = scratch_path(spark, "counted")
    rows = [("rebuild", store.rebuild(raw.filter(F.col("Shipping_State") <= "IL"))), ("append", store.append(raw))]
    rows += anon.anonymize(fx.raw_names(spark, sf), f"{path}/public", f"{path}/private").items()
    return spark.createDataFrame(rows, "step string, n long")


# Extraction


def text_sufficiency(spark, sf):
    pages = fx.page_table(spark, sf)
    return pages.select("path", has_sufficient_text(F.col("text")).alias("sufficient"))


def page_routing(spark, sf):
    return extract.route_pages(fx.page_table(spark, sf)).select("Source_File", "Source_Page", "route")


def page_range(spark, sf):
    pages = projection.page_range(fx.page_table(spark, sf), 1, 4)
    return pages.select("path", "page_index")


def extract_records(spark, sf):
    log = extract.extract(fx.page_table(spark, sf), SLIP_READER)
    return extract.records_of(log).drop("line_no")


def extract_counters(spark, sf):
    return extract.run_counters(extract.extract(fx.page_table(spark, sf), SLIP_READER))


def quarantine(spark, sf):
    log = extract.extract(fx.page_table(spark, sf), SLIP_READER)
    return extract.quarantine(log).drop("error", *extract.PAGE_KEY)


def parse_responses(spark, sf):
    log = extract.explode_records(extract.with_status(fx.line_pages(spark, sf)))
    return log.drop("route", "error", "response", *extract.PAGE_KEY)


def verify_merge(spark, sf):
    log = extract.explode_records(extract.with_status(fx.line_pages(spark, sf)))
    records = log.filter(F.col("line_no").isNotNull())
    merged = extract.merge_verifications(records, fx.verifications(spark, sf))
    return merged.select("Source_File", "Source_Page", "line_no", *EXTRACTED_COLUMNS)


def stream_extract(spark, sf):
    """The page table as files, read as a stream; same records as in batch."""
    base = scratch_path(spark, "stream")
    _put(fx.page_table(spark, sf), f"{base}/pages")
    query = stream_extraction(
        spark, f"{base}/pages", f"{base}/log", f"{base}/checkpoint", SLIP_READER
    )
    query.awaitTermination()
    return extract.records_of(read_log(spark, f"{base}/log")).drop("line_no")


def run_extraction(spark, sf):
    """A run while the reader is down, then one that reads every page still open."""
    def down(_client, _page):
        raise RuntimeError("no service")

    path = scratch_path(spark, "log")
    pages = fx.page_table(spark, sf)
    extract.run_extraction(spark, pages, path, replace(SLIP_READER, read_text=down, read_image=down))
    log = extract.run_extraction(spark, pages, path, SLIP_READER)
    return extract.records_of(log).drop("line_no")


def stream_restart(spark, sf):
    """Half of the pages as a stream, then all of them under a new checkpoint: one log, each page once."""
    base = scratch_path(spark, "restart")
    pages = fx.page_table(spark, sf)
    half = F.pmod(F.xxhash64("path", "page_index"), F.lit(2))
    for n in (0, 1):
        _put(pages.filter(half == n), f"{base}/pages", "append")
        stream_extraction(
            spark, f"{base}/pages", f"{base}/log", f"{base}/checkpoint-{n}", SLIP_READER
        ).awaitTermination()
    return extract.records_of(read_log(spark, f"{base}/log")).drop("line_no")


def page_source(spark, sf):
    """Pages written as a table and read back through the range filter."""
    path = scratch_path(spark, "pages")
    fx.page_table(spark, sf).write.parquet(path)
    return read_pages(spark, path, start=2).select("path", "page_index")


# Anonymisation


def anonymize_rules(spark, sf):
    """The rules under a fixed identity for each customer."""
    lines = fx.raw_names(spark, sf)
    keys = lines.select(anon.customer_key(F.col("Customer_Name")).alias("cust_key")).distinct()
    digest = F.md5("cust_key")
    identities = keys.select(
        "cust_key",
        F.concat(F.lit("Member "), digest).alias("fake_name"),
        F.concat(digest, F.lit("@example.org")).alias("fake_email"),
        F.concat(F.lit("1 "), digest, F.lit(" Rd")).alias("fake_line1"),
    )
    path = scratch_path(spark, "identities")
    return anon.apply_identities(lines, _put(identities, path), SCRUB)


def anonymize_audit(spark, sf):
    """A random draw, written and read back, then audited against the source."""
    path = scratch_path(spark, "anonymized")
    lines = _put(fx.raw_names(spark, sf), f"{path}/source")
    identities = _put(anon.draw_identities(lines), f"{path}/identities")
    after = _put(anon.apply_identities(lines, identities, SCRUB), f"{path}/lines")
    return audits.audit(lines, after, identities, SCRUB, path=f"{path}/groups")


def anonymize_job(spark, sf):
    """The whole job; revenue by month of the CSV it leaves is that of the source."""
    path = scratch_path(spark, "job")
    anon.anonymize(fx.order_lines_raw(spark, sf), f"{path}/public", f"{path}/private", SCRUB)
    silver = typed.silver_lines(read_order_lines(spark, f"{path}/public"))
    return reports.revenue_by_month(orders.order_level(silver))


def private_mapping(spark, sf):
    """The mapping that the job leaves: a row a customer, under the first spelling of the name."""
    path = scratch_path(spark, "mapping")
    anon.anonymize(fx.raw_names(spark, sf), f"{path}/public", f"{path}/private", SCRUB)
    mapping = spark.read.options(header=True, quote='"', escape='"').csv(f"{path}/private/mapping")
    named = mapping.select(F.coalesce("real_name", F.lit("")).alias("real_name"), "fake_name", "fake_email")
    alike = F.count(F.lit(1)).over(Window.partitionBy("fake_name"))
    return named.select("real_name", (alike == 1).alias("own_name"), F.col("fake_email").contains("@").alias("has_email"))


def source_quality(spark, sf):
    return audits.source_quality(fx.raw_names(spark, sf))


QUERIES = {
    "conform": conform,
    "rename_display": rename_display,
    "browse": browse,
    "search_document": search_document,
    "provenance": provenance,
    "scan_limit": scan_limit,
    "typed_lines": typed_lines,
    "clean_order_number": clean_order_numbers,
    "reclean_count": reclean_count,
    "zip_prefix": zip_area,
    "token_scrub": token_scrub,
    "token_scrub_many": token_scrub_many,
    "customer_key": customer_key,
    "category": category,
    "canonical_products": canonical_products,
    "order_level": order_level,
    "kpis": kpis,
    "category_mix": category_mix,
    "revenue_by_month": revenue_by_month,
    "top_products": top_products,
    "customer_value": customer_value,
    "loyalty_kpis": loyalty_kpis,
    "loyalty_segments": loyalty_segments,
    "orders_by_state": orders_by_state,
    "summary_stats": summary_stats,
    "summary_top_products": summary_top_products,
    "summary_sources": summary_sources,
    "order_totals": order_totals,
    "refresh_kpis": refresh_kpis,
    "refresh_customer_value": refresh_customer_value,
    "refresh_summary": refresh_summary,
    "filter_equality": filter_equality,
    "search_exact_order": search_exact_order,
    "search_email": search_email,
    "search_text": search_text,
    "search_literal": search_literal,
    "search_ranked": search_ranked,
    "search_indexed": search_indexed,
    "search_batch": search_batch,
    "search_count": search_count,
    "vector_topk": vector_topk,
    "vector_topk_many": vector_topk_many,
    "csv_roundtrip": csv_roundtrip,
    "csv_split_read": csv_split_read,
    "store_rebuild": store_rebuild,
    "store_append": store_append,
    "store_update": store_update,
    "store_delete": store_delete,
    "store_reload": store_reload,
    "lookup_by_id": lookup_by_id,
    "import_counters": import_counters,
    "text_sufficiency": text_sufficiency,
    "page_routing": page_routing,
    "page_range": page_range,
    "page_source": page_source,
    "extract_records": extract_records,
    "extract_counters": extract_counters,
    "quarantine": quarantine,
    "parse_responses": parse_responses,
    "verify_merge": verify_merge,
    "stream_extract": stream_extract,
    "run_extraction": run_extraction,
    "stream_restart": stream_restart,
    "anonymize_rules": anonymize_rules,
    "anonymize_audit": anonymize_audit,
    "anonymize_job": anonymize_job,
    "private_mapping": private_mapping,
    "source_quality": source_quality,
}
