"""The crawl as one stream: a page's state is kept under its URL, and a timer says when it is due again.

Events are seeds, fetch results and ticks of a clock. What a batch reads is its events and the states of their pages, however long the
crawl has gone on: nothing is scanned to find out what is due. A page comes out when it changes, and when it is due: at once
when it is seeded, and by its timer after a fetch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from folioscope.operators.crawl import COLUMNS, STATE
from folioscope.sources.http import FETCHED
from folioscope.storage import saved

#: ``kind`` is seed, fetched or tick; a tick, whose URL is empty, only says how late it is.
EVENTS = "url string, at timestamp, kind string, source string, status string, html string, etag string, last_modified string, error string"
#: State rows; those with ``due`` are to be fetched, the others are what has changed.
PAGES = f"{STATE}, due boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def after_fetch(page: dict, fetched: dict, now: int, interval: int) -> dict:
    """``page`` after a fetch, as ``operators.crawl.transition`` has it."""
    out = page | {"fetched_at": now, "next_crawl_at": now + interval}
    if fetched["status"] == "error":
        return out | {"status": "error", "error": fetched["error"]}
    out |= {"status": "done", "error": None}
    if fetched["status"] == "ok":
        out |= {"etag": fetched["etag"], "last_modified": fetched["last_modified"]}
        digest = hashlib.sha256((fetched["html"] or "").encode("utf-8", "surrogatepass")).hexdigest()
        if page["content_hash"] != digest:
            out |= {"html": fetched["html"], "content_hash": digest}
    return out


class Recrawler(StatefulProcessor):
    """Keeps the page of each URL. Failed pages have a timer only if they are to be tried again, as in ``operators.crawl.due``."""

    def __init__(self, interval: int, retry_errors: bool = False):
        self.interval, self.retry_errors = interval, retry_errors

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", STATE)

    def known(self) -> dict | None:
        return dict(zip(COLUMNS, self.page.get())) if self.page.exists() else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        page, new, changed = self.known(), False, False
        for row in sorted(rows, key=lambda r: (r.second, r.kind != "seed", r.status or "", r.html or "", r.error or "")):
            if row.kind == "seed" and page is None:
                page = dict.fromkeys(COLUMNS) | {"url": key[0], "source": row.source, "next_crawl_at": 0, "status": "new"}
                new = changed = True
            elif row.kind == "fetched" and page is not None:
                page = after_fetch(page, row.asDict(), row.second, self.interval)
                new, changed = False, True
        if changed:
            self.page.update(tuple(page[c] for c in COLUMNS))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if page["status"] == "done" or (page["status"] == "error" and self.retry_errors):
                self.handle.registerTimer(page["next_crawl_at"] * 1000)
            yield Row(**page, due=new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        page = self.known()
        if page is not None:
            yield Row(**page, due=True)

    def close(self) -> None:
        pass


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events as they are added to a folder as Parquet files."""
    return spark.readStream.schema(EVENTS).parquet(path)


def seed_events(pages: DataFrame, now: int) -> DataFrame:
    """``EVENTS`` that make pages (url, source) known."""
    return events_of(pages.select("url", "source", F.lit("seed").alias("kind")), now)


def fetch_events(fetched: DataFrame, now: int) -> DataFrame:
    """``EVENTS`` of fetch results (``FETCHED``)."""
    return events_of(fetched.withColumn("kind", F.lit("fetched")), now)


def tick(spark: SparkSession, now: int) -> DataFrame:
    """The event that says how late it is."""
    return events_of(spark.createDataFrame([("", "tick")], "url string, kind string"), now)


def events_of(rows: DataFrame, now: int) -> DataFrame:
    kinds = dict(c.split() for c in EVENTS.split(", "))
    own = {c: F.col(c) if c in rows.columns else F.lit(None) for c in kinds} | {"at": F.timestamp_seconds(F.lit(now))}
    return rows.select(*(own[c].cast(kinds[c]).alias(c) for c in kinds))


def recrawl(events: DataFrame, interval: int, retry_errors: bool = False, clock: str = "processingTime") -> DataFrame:
    """``PAGES`` of a stream of ``EVENTS``: what changes, and what is due.

    By the ``processingTime`` a page is due when its batch begins later than its timer; by the ``eventTime`` once events are more than a second later, ticks among
    them. The session's state store must be RocksDB (``ROCKS``), which keeps timers.
    """
    # Events of the latest second are not late.
    timed = events.withWatermark("at", "1 second") if clock == "eventTime" else events
    return timed.withColumn("second", F.col("at").cast("long")).groupBy("url").transformWithState(Recrawler(interval, retry_errors), PAGES, "update", clock)


def follow(
    pages: DataFrame, events_path: str, pages_path: str, fetch: Callable[[DataFrame], DataFrame], checkpoint: str, clock: Callable[[], int]
) -> DataStreamWriter:
    """Closes the circle: what is due goes through ``fetch`` (state rows to ``FETCHED``), and its results back into the events.

    The rows of batch n are kept as ``pages_path``/batch=n. A batch that runs again writes the same places anew. The writer is returned
    for the caller to start.
    """

    def apply(batch: DataFrame, number: int) -> None:
        own = saved(batch, "pages")
        own.write.mode("overwrite").parquet(f"{pages_path}/batch={number}")
        due = own.where("due").select(COLUMNS)
        if not due.isEmpty():
            fetched = saved(fetch(due).select([c.split()[0] for c in FETCHED.split(", ")]), "fetched")
            fetch_events(fetched, clock()).write.mode("append").parquet(events_path)

    return pages.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint)


def last_pages(spark: SparkSession, pages_path: str) -> DataFrame:
    """The latest state row of each page that a followed stream has kept."""
    rows = spark.read.schema(f"{PAGES}, batch long").parquet(pages_path)
    last = rows.groupBy("url").agg(F.max_by(F.struct(*COLUMNS), F.struct("batch", ~F.col("due"))).alias("p"))
    return last.select("p.*")
