import pytest
from pyspark.sql import functions as F

from folioscope.operators import crawl
from folioscope.sources.http import FETCHED
from folioscope.streaming import recrawl

T0, INTERVAL = 1_000_000, 100


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", recrawl.ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def answer(n):
    """What the web says in round ``n``: pages that change, stay, are not changed, and fail in the second round."""

    def fetch(due):
        i = F.substring("url", 2, 9).cast("int") % 4
        status = F.when(i == 2, "not_changed" if n else "ok").when((i == 3) & F.lit(n == 1), "error").otherwise("ok")
        html = F.when(status == "ok", F.when(i == 0, F.concat("url", F.lit(f" {n}"))).otherwise(F.col("url")))
        return due.select("url", status.alias("status"), html.alias("html"), F.when(status == "ok", F.lit(f"E{n}")).alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.when(status == "error", "HTTP 500").alias("error"))

    return fetch


def test_rounds_by_timers(rocks, tmp_path):
    """Three rounds give the rows of ``transition`` over the whole table, and each asks for what is due alone."""
    spark = rocks
    events, pages, checkpoint = (str(tmp_path / x) for x in ("events", "pages", "cp"))
    seeds = spark.createDataFrame([(f"u{i}", "s") for i in range(9)] + [("u1", "s")], "url string, source string")
    expected = crawl.new_state(seeds, F.col("url"), F.col("source"))
    recrawl.seed_events(seeds, T0).write.parquet(events)
    asked = []
    for n, now in enumerate((T0, T0 + INTERVAL + 5, T0 + 2 * INTERVAL + 10)):
        def fetch(due, n=n):
            asked.append((n, sorted(r.url for r in due.collect())))
            return answer(n)(due)

        def run(fetch=fetch, now=now):
            out = recrawl.recrawl(recrawl.read_events(spark, events), INTERVAL, clock="eventTime")
            recrawl.follow(out, events, pages, fetch, checkpoint, lambda: now).trigger(availableNow=True).start().awaitTermination(120)

        if n:
            recrawl.tick(spark, now).write.mode("append").parquet(events)
        run()  # what is due is asked for
        run()  # its results come in
        due = crawl.queue(expected, now, 100)
        expected = spark.createDataFrame(crawl.transition(expected, answer(n)(due), now, INTERVAL).collect(), crawl.STATE)
        assert sorted(map(tuple, recrawl.last_pages(spark, pages).collect())) == sorted(map(tuple, expected.collect()))
    everything = [f"u{i}" for i in range(9)]
    assert asked == [(0, everything), (1, everything), (2, [u for u in everything if u not in ("u3", "u7")])]  # failed ones are not tried again


def test_after_fetch_is_transition(spark):
    old = {"url": "u", "source": "s", "html": "h", "fetched_at": 1, "etag": "e", "last_modified": "l", "content_hash": "x", "next_crawl_at": 2, "status": "done", "error": "old"}
    for status, html, error in (("error", None, "HTTP 500"), ("not_changed", None, None), ("ok", "new", None), ("ok", None, None)):
        for content in (None, "x", "11507a0e2f5e69d5dfa40a62a1bd7b6ee57e6bcd85c67c9b8431b36fff21c437"):
            page = old | {"content_hash": content}
            fetched = {"url": "u", "status": status, "html": html, "etag": "E", "last_modified": None, "error": error}
            state = spark.createDataFrame([tuple(page[c] for c in crawl.COLUMNS)], crawl.STATE)
            (row,) = crawl.transition(state, spark.createDataFrame([tuple(fetched.values())], FETCHED), 50, 7).collect()
            assert recrawl.after_fetch(page, fetched, 50, 7) == row.asDict()
