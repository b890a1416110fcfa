"""Incremental extraction with state by page: work follows the new pages, not the log.

Each page is a key. Its state says whether it is settled; a page that failed, or that the
trigger's budget of calls had no room for, is kept there with its text or image until a
timer brings it back. Failures wait longer each time, and after the last attempt the page
stays failed. So a trigger looks up the keys of its own pages and of those that are due,
however long the log is, and calls the reader a bounded number of times.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from orderlake.plans.extract import PAGE_KEY, Reader, read_pages_log, route_pages
from orderlake.schema import PAGE_SCHEMA
from orderlake.sources.existing import read_if_there
from orderlake.sources.pages import FILE_SCHEMA, image_pages

_PAGE = "Source_File string, Source_Page string, route string, text string, content binary"
_STATE = f"{_PAGE}, attempts int"
_READ = "path string, page_index int, Source_File string, Source_Page string, route string, content binary, response string, error string"
# The only state store that holds timers and several values a key.
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GRACE_SECONDS = 10.0
SETTLED = -1
_ANSWERED = Row(*(field.split()[0] for field in _READ.split(", ")))
_FIELDS = [field.split()[0] for field in _PAGE.split(", ")]


class PageProcessor(StatefulProcessor):
    """Reads a page once it is there, again after a failure, and never after it is settled.

    A page's state is its fields and the attempts made while it waits, and ``SETTLED`` attempts alone afterwards.
    """

    def __init__(self, reader: Reader, calls: int | None, attempts: int, delay_ms: int):
        self.reader, self.calls, self.attempts, self.delay_ms = reader, calls, attempts, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", _STATE)
        self.made, self.client = 0, None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = next(iter(rows))
        if self.page.get() is None:
            yield from self._read(key, tuple(first[f] for f in _FIELDS), 0, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        *page, attempts = self.page.get()
        if attempts != SETTLED:
            yield from self._read(key, tuple(page), attempts, timerValues)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._settle()

    def _read(self, key, page: tuple, attempts: int, timer) -> Iterator[Row]:
        *named, route, text, content = page
        called = route != "none"
        if called and self.calls is not None and self.made >= self.calls:
            # Not this time: the next trigger finds it due.
            self._wait(page, attempts, timer.getCurrentProcessingTimeInMs() + 1)
            return
        response = error = None
        try:
            if called:
                self.made += 1
                self.client = self.client or (self.reader.connect(),)
                read = self.reader.read_text if route == "text" else self.reader.read_image
                response = read(self.client[0], text if route == "text" else bytes(content))
        except Exception as problem:  # one bad page must not stop the run
            error = f"{type(problem).__name__}: {problem}"
        if error and attempts + 1 < self.attempts:
            self._wait(page, attempts + 1, timer.getCurrentProcessingTimeInMs() + self.delay_ms * 2**attempts)
        else:
            self._settle()
        yield _ANSWERED(*key, *named, route, content if route == "image" else None, response, error)

    def _wait(self, page: tuple, attempts: int, until: int) -> None:
        self.page.update((*page, attempts))
        self.handle.registerTimer(until)

    def _settle(self) -> None:
        self.page.update((*[None] * len(_FIELDS), SETTLED))

    def close(self) -> None:
        pass


def stream_extraction_by_page(
    spark: SparkSession,
    pages_path: str,
    log_path: str,
    checkpoint_path: str,
    reader: Reader,
    files_per_batch: int = 1000,
    images: str | None = None,
    calls_per_trigger: int | None = None,
    attempts: int = 3,
    delay_seconds: float = 60.0,
    trigger: str = "1 second",
) -> StreamingQuery:
    """``stream_extraction`` with state by page, retries and a budget; it runs until it is stopped (see ``finish``).

    ``calls_per_trigger`` bounds the reader's calls of one trigger (each of the state's partitions has an equal share, one
    at least); pages beyond it come first in later ones. A page that fails is read again after ``delay_seconds``, then twice
    as long, until ``attempts`` are made. Every attempt is a row of the log, in which a failure counts only while
    no success follows. Waiting pages outlive the query; after a restart the first new file sets off the triggers that look
    for them. A query with a new checkpoint begins with the pages that the log has settled; later ones never look
    at the log. Null texts and images make a page without a route, which is settled at once; of rows with the same key
    the first counts.
    """
    source = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    if images:
        pages = image_pages(source.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", images).load(pages_path))
    else:
        pages = source.schema(PAGE_SCHEMA).parquet(pages_path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = None if calls_per_trigger is None else max(1, calls_per_trigger // parts)
    log = read_if_there(spark, log_path)
    known = None
    if log is not None:
        known = log.where("status <> 'failed'").select(*PAGE_KEY).distinct().groupBy(*PAGE_KEY)
    routed = route_pages(pages).select(*PAGE_KEY, *_FIELDS)
    read = routed.groupBy(*PAGE_KEY).transformWithState(
        PageProcessor(reader, share, attempts, int(delay_seconds * 1000)),
        outputStructType=_READ,
        outputMode="append",
        timeMode="processingTime",
        initialState=known,
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        made = read_pages_log(batch, reader)
        made.write.mode("overwrite").parquet(f"{log_path.rstrip('/')}/run={run}/batch={batch_id}")

    writer = read.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint_path)
    with _setting(spark, _STORE, _ROCKSDB):
        return writer.trigger(processingTime=trigger).start()


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    """A setting for a query that starts meanwhile; it keeps a copy of its own."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def finish(query: StreamingQuery, idle_seconds: float = 0.0) -> None:
    """Stop a query that has found nothing to do for ``idle_seconds``: no new page and none that was due.

    Pages that wait longer stay with the checkpoint, for the first trigger with a new file of the next query.
    """
    since, seen = None, -1
    while query.isActive:
        progress = query.lastProgress
        if progress and progress["batchId"] > seen:
            seen = progress["batchId"]
            states = progress["stateOperators"]
            busy = progress["numInputRows"] > 0 or any(x["numRowsUpdated"] for x in states)
            since = None if busy else since or time.monotonic()
        # Between two triggers if there is a time between them, so that no batch is cut off.
        rest = time.monotonic() - since - idle_seconds if since else -1.0
        if rest >= GRACE_SECONDS or (rest >= 0 and not query.status["isTriggerActive"]):
            query.stop()
            return
        time.sleep(0.05)
    query.awaitTermination()
