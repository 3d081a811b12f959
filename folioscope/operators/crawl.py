"""Crawl bookkeeping: seeds, the queue, and what a round of fetches makes of the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.urls import normalize_url, seed_url

STATE = (
    "url string, source string, html string, fetched_at long, etag string, last_modified string, "
    "content_hash string, next_crawl_at long, status string, error string"
)
COLUMNS = [c.split()[0] for c in STATE.split(", ")]


def new_state(pages: DataFrame, url: Column, source: Column) -> DataFrame:
    """A state row, status new and due at once, for each distinct URL of ``pages``."""
    fixed = {"url": url, "source": source, "next_crawl_at": F.lit(0).cast("long"), "status": F.lit("new")}
    kinds = dict(c.split() for c in STATE.split(", "))
    rows = pages.select([fixed.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS])
    return rows.groupBy("url").agg(*[F.min(c).alias(c) for c in COLUMNS if c != "url"]).select(COLUMNS)


def seeds(titles: DataFrame, base_url: str, source: str) -> DataFrame:
    """State rows of a list of page titles."""
    return new_state(titles, seed_url(F.col("title"), base_url), F.lit(source))


def upsert_seeds(state: DataFrame, seeded: DataFrame) -> DataFrame:
    """``state`` and the seeds whose URL it does not have."""
    return state.select(COLUMNS).unionByName(seeded.join(state.select("url"), "url", "left_anti").select(COLUMNS))


def load_seeds(state: DataFrame, seeded: DataFrame) -> DataFrame:
    """The seeds if ``state`` has no row yet; else ``state``."""
    return upsert_seeds(state, seeded) if state.isEmpty() else state


def due(now: int, retry_errors: bool = False) -> Column:
    """New pages, and fetched ones whose time has come; failed ones only if asked for."""
    late = F.col("next_crawl_at") <= now
    again = F.col("status").isin("done", "error") if retry_errors else F.col("status") == "done"
    return (F.col("status") == "new") | (again & late)


def queue(state: DataFrame, now: int, limit: int, retry_errors: bool = False) -> DataFrame:
    """The next ``limit`` pages to fetch, the longest due first."""
    return state.where(due(now, retry_errors)).orderBy("next_crawl_at", "url").limit(limit)


def classify(http_status: Column, error: Column) -> tuple[Column, Column]:
    """(status, error text) of a response: not_changed for 304, ok for 200, else error."""
    status = F.when(error.isNotNull(), F.lit("error")).when(http_status == 304, F.lit("not_changed")).when(http_status == 200, F.lit("ok")).otherwise(F.lit("error"))
    text = F.when(error.isNotNull(), error).when(~http_status.isin(200, 304), F.concat(F.lit("HTTP "), http_status.cast("string")))
    return status, text


def transition(state: DataFrame, fetched: DataFrame, now: int, interval: int) -> DataFrame:
    """``state`` after fetches (url, status, html, etag, last_modified, error), one a URL at most.

    An error keeps content and validators. Unchanged keeps them too and clears the error. A
    good fetch takes the new validators, even if null, and the new content only if its hash differs.
    """
    f = fetched.select("url", *[F.col(c).alias(f"f_{c}") for c in ("status", "html", "etag", "last_modified", "error")])
    j = state.join(f, "url", "left")
    met, ok = F.col("f_status").isNotNull(), F.coalesce(F.col("f_status") == "ok", F.lit(False))
    new_hash = F.sha2(F.coalesce("f_html", F.lit("")), 256)
    changed = ok & ~F.col("content_hash").eqNullSafe(new_hash)
    pick = lambda cond, a, b: F.when(cond, a).otherwise(b)
    after = {
        "html": pick(changed, F.col("f_html"), F.col("html")),
        "content_hash": pick(changed, new_hash, F.col("content_hash")),
        "etag": pick(ok, F.col("f_etag"), F.col("etag")),
        "last_modified": pick(ok, F.col("f_last_modified"), F.col("last_modified")),
        "fetched_at": pick(met, F.lit(now).cast("long"), F.col("fetched_at")),
        "next_crawl_at": pick(met, F.lit(now + interval).cast("long"), F.col("next_crawl_at")),
        "status": F.when(F.col("f_status") == "error", F.lit("error")).when(met, F.lit("done")).otherwise(F.col("status")),
        "error": F.when(F.col("f_status") == "error", F.col("f_error")).when(met, F.lit(None)).otherwise(F.col("error")),
    }
    return j.select([after.get(c, F.col(c)).alias(c) for c in COLUMNS])


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html): the page of smallest id for each normalized URL."""
    own = pages.withColumn("url", normalize_url(F.col("url")))
    return own.groupBy("url").agg(F.min(F.struct("page_id", "html")).alias("x")).select("x.page_id", "url", "x.html")
