"""Conditional page fetches, in tasks that have whole hosts."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.urls import host_of

FETCHED = "url string, status string, html string, etag string, last_modified string, error string"
AGENT = "folioscope/1 (crawler)"
#: From (url, headers) to (HTTP status, body, headers); raises OSError.
Get = Callable[[str, dict], tuple[int, str, dict]]


def http_get(url: str, headers: dict, timeout: float = 20.0) -> tuple[int, str, dict]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
            return answer.status, answer.read().decode("utf-8", "replace"), dict(answer.headers)
    except urllib.error.HTTPError as e:
        return e.code, "", dict(e.headers)


def fetch_one(url: str, etag: str | None, last_modified: str | None, get: Get) -> tuple:
    """A row of ``FETCHED``: 304 is not_changed, 200 ok, anything else an error."""
    headers = {"User-Agent": AGENT} | ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": last_modified} if last_modified else {})
    try:
        code, body, answer = get(url, headers)
    except Exception as e:  # whatever a fetch raises is the page's error
        return url, "error", None, None, None, str(e)
    if code == 304:
        return url, "not_changed", None, None, None, None
    if code != 200:
        return url, "error", None, None, None, f"HTTP {code}"
    return url, "ok", body, answer.get("ETag"), answer.get("Last-Modified"), None


def fetch_pages(queue: DataFrame, get: Get = http_get, delay: float = 0.5, tasks: int | None = None) -> DataFrame:
    """``FETCHED`` of the queued state rows, those of one host ``delay`` seconds apart.

    Hosts are dealt out over ``tasks``, all of a host to one task, as only that keeps its pages apart. A task takes its hosts
    in turns, so that it waits only where one host is left.
    """
    n = tasks or queue.sparkSession.sparkContext.defaultParallelism
    asked = queue.select("url", "etag", "last_modified", host_of(F.col("url")).alias("host"))
    turn = F.row_number().over(Window.partitionBy("host").orderBy("url"))
    dealt = asked.withColumn("turn", turn).repartition(n, "host").sortWithinPartitions("turn", "host").drop("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, float] = {}
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                time.sleep(max(0.0, ready.get(row["host"], 0.0) - time.monotonic()))
                rows.append(fetch_one(row["url"], row["etag"], row["last_modified"], get))
                ready[row["host"]] = time.monotonic() + delay
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], [c.split()[0] for c in FETCHED.split(", ")])

    return dealt.mapInArrow(run, FETCHED)
