import hashlib
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from folioscope.operators import crawl, graph
from folioscope.sources import http, wiki
from folioscope.streaming.crawl import crawl as crawl_all
from folioscope.streaming.crawl import crawl_round, keep_state, read_fetches, read_state

NOW, LATER = 1000, 100
HASH = hashlib.sha256(b"<html>content</html>").hexdigest()


def state(spark, *rows):
    names = crawl.COLUMNS
    full = [tuple(r.get(c) for c in names) for r in rows]
    return spark.createDataFrame(full, crawl.STATE)


def row(url, **x):
    return {"url": url, "source": "s", "next_crawl_at": 0, "status": "new"} | x


def test_seeds_go_into_an_empty_store_only(spark):
    titles = spark.createDataFrame([("A b",), ("A b",)], "title string")
    seeded = crawl.seeds(titles, "https://x/wiki/", "w")
    empty = state(spark)
    first = crawl.load_seeds(empty, seeded).collect()
    assert [(r.url, r.status, r.next_crawl_at) for r in first] == [("https://x/wiki/A_b", "new", 0)]
    assert [r.url for r in crawl.load_seeds(state(spark, row("u")), seeded).collect()] == ["u"]
    assert crawl.upsert_seeds(crawl.load_seeds(empty, seeded), seeded).count() == 1


def test_queue(spark):
    s = state(spark, row("a", status="done", next_crawl_at=9999999999), row("b"), row("c", status="error"), row("d", status="done", next_crawl_at=5))
    assert [r.url for r in crawl.queue(s, NOW, 10).collect()] == ["b", "d"]
    assert [r.url for r in crawl.queue(s, NOW, 10, retry_errors=True).collect()] == ["b", "c", "d"]


def fail(url, headers):
    raise OSError("boom")


@pytest.mark.parametrize(
    ("get", "expected"),
    [
        (fail, ("error", None, None, None, "boom")),
        (lambda u, h: (304, "", {}), ("not_changed", None, None, None, None)),
        (lambda u, h: (500, "", {}), ("error", None, None, None, "HTTP 500")),
        (lambda u, h: (200, "<html>", {"ETag": "E2", "Last-Modified": "L2"}), ("ok", "<html>", "E2", "L2", None)),
    ],
)
def test_fetch(get, expected):
    assert http.fetch_one("u", "E", "L", get) == ("u", *expected)


def test_validators_are_sent():
    seen = {}
    http.fetch_one("u", "E", "L", lambda u, h: seen.update(h) or (304, "", {}))
    assert (seen["If-None-Match"], seen["If-Modified-Since"]) == ("E", "L")


def test_round(spark):
    s = state(spark, row("u"), row("v", status="done", next_crawl_at=10**12, html="old"))
    get = lambda url, headers: (200, "<html>content</html>", {"ETag": "e"})
    after = {r.url: r for r in crawl_round(s, lambda q: http.fetch_pages(q, get, 0), NOW, LATER, 5).collect()}
    assert (after["u"].status, after["u"].html, after["u"].content_hash, after["u"].next_crawl_at) == ("done", "<html>content</html>", HASH, NOW + LATER)
    assert after["v"].html == "old"


def test_transitions(spark):
    old = {"html": "h", "content_hash": HASH, "etag": "e", "last_modified": "l", "status": "done", "error": "x", "fetched_at": 1}
    s = state(spark, *[row(u, **old) for u in ("err", "same", "unchanged", "changed", "none")])
    results = [
        ("err", "error", None, None, None, "HTTP 500"),
        ("unchanged", "not_changed", None, None, None, None),
        ("same", "ok", "<html>content</html>", None, "L", None),
        ("changed", "ok", "new", "E", None, None),
    ]
    got = {r.url: r for r in crawl.transition(s, spark.createDataFrame(results, http.FETCHED), NOW, LATER).collect()}
    assert (got["err"].status, got["err"].error, got["err"].html, got["err"].etag) == ("error", "HTTP 500", "h", "e")
    assert (got["unchanged"].status, got["unchanged"].error, got["unchanged"].etag) == ("done", None, "e")
    assert (got["same"].html, got["same"].etag, got["same"].last_modified) == ("h", None, "L")
    assert (got["changed"].html, got["changed"].content_hash) == ("new", hashlib.sha256(b"new").hexdigest())
    assert (got["none"].status, got["none"].fetched_at, got["none"].error) == ("done", 1, "x")


def test_crawl_until_nothing_is_due(spark):
    s = state(spark, *[row(f"http://h{i % 3}/{i}") for i in range(11)], row("http://h/later", status="done", next_crawl_at=10**12, html="old"))
    get = lambda url, headers: (500, "", {}) if url.endswith("/7") else (200, url, {})
    fetch = lambda q: http.fetch_pages(q, get, 0, 3)
    after = {r.url: r for r in crawl_all(s, fetch, LATER, a_round=4, clock=lambda: NOW).collect()}
    assert {u: r.status for u, r in after.items()} == {r.url: "error" if r.url.endswith("/7") else "done" for r in s.collect()}
    assert after["http://h1/4"].html == "http://h1/4" and after["http://h/later"].html == "old"
    some = crawl_all(s, fetch, LATER, max_documents=5, a_round=3, clock=lambda: NOW)
    assert some.where("fetched_at is not null").count() == 5 and some.count() == 12
    assert crawl_all(s.limit(0), fetch, LATER, clock=lambda: NOW).count() == 0


def test_hosts_wait_and_are_dealt_out(spark):
    began = time.monotonic()
    urls = [f"http://h{i % 4}/{i}" for i in range(12)] + ["no url"]

    def get(url, headers):
        return 200, f"{time.monotonic()} {os.getpid()}", {}

    rows = http.fetch_pages(state(spark, *map(row, urls)).coalesce(1), get, 0.3, 4).collect()
    assert sorted(r.url for r in rows) == sorted(urls)
    times = {}
    for r in rows:
        times.setdefault(r.url.rpartition("/")[0], []).append(r.html.split())
    for own in times.values():
        at = sorted(float(x[0]) for x in own)
        assert all(b - a >= 0.29 for a, b in zip(at, at[1:])) and len({x[1] for x in own}) == 1
    assert len({x[1] for own in times.values() for x in own}) > 1 and time.monotonic() > began


def test_stream(spark, tmp_path):
    base, fetched = str(tmp_path / "state"), str(tmp_path / "fetched")
    state(spark, row("u"), row("v"), row("w")).write.parquet(f"{base}/state")
    assert read_state(spark, base).count() == 3

    def add(*results):
        spark.createDataFrame([(*r, None, None, None) for r in results], http.FETCHED).write.mode("append").parquet(fetched)
        writer = keep_state(read_fetches(spark, fetched), base, str(tmp_path / "cp"), NOW, LATER).trigger(availableNow=True)
        writer.start().awaitTermination(60)
        return {r.url: (r.status, r.html) for r in read_state(spark, base).collect()}

    assert add(("u", "ok", "x")) == {"u": ("done", "x"), "v": ("new", None), "w": ("new", None)}
    assert add(("u", "ok", "y"), ("w", "ok", "z"), ("other", "ok", "o")) == {"u": ("done", "y"), "v": ("new", None), "w": ("done", "z")}
    assert spark.read.parquet(f"{base}/changes/round=1").count() == 2  # the pages of the batch alone


@pytest.mark.parametrize("shallow", [0, 3, 12])
def test_levels_against_a_plain_walk(spark, shallow):
    rnd = random.Random(shallow)
    edges = [(f"r{i}", f"r{i + 1}") for i in range(9)] + [("r9", "r4")]  # a ring behind a tail
    edges += [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("c20", "c35"), ("c3", "x0"), ("x5", "c30"), ("alone", "alone")]
    edges += [(f"x{rnd.randrange(30)}", f"x{rnd.randrange(30)}") for _ in range(45)]
    roots = ["r0", "c0", "x1", "alone", "nowhere"]
    level, front = dict.fromkeys(roots, 0), roots
    while front:
        front = sorted({b for a, b in edges if a in front} - set(level))
        level |= dict.fromkeys(front, max(level.values()) + 1)
    steps = spark.createDataFrame([("w", a, b) for a, b in edges + edges[:3]], "source string, category string, next string")
    asked = spark.createDataFrame([("w", r) for r in roots + roots], "source string, category string")
    got = graph.category_levels(asked, steps, shallow=shallow).collect()
    assert sorted((r.category, r.level) for r in got) == sorted(level.items())
    some = graph.category_levels(asked, steps, max_depth=7, shallow=shallow).collect()
    assert sorted((r.category, r.level) for r in some) == sorted((c, n) for c, n in level.items() if n <= 7)


def test_a_thousand_levels(spark):
    n, group = 1000, "levels"
    steps = spark.createDataFrame([("w", f"C{i}", f"C{i + 1}") for i in range(n)], "source string, category string, next string")
    roots = spark.createDataFrame([("w", "C0")], "source string, category string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a job for each action, not for each of its stages
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = {r.category: r.level for r in graph.category_levels(roots, steps).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {f"C{i}": i for i in range(n + 1)} and jobs < 50


def test_deep_categories(spark):
    n = 70
    edges = [("w", f"C{i}", 14, f"C{i + 1}", None) for i in range(n)] + [("w", f"C{n}", 0, "p", 1)]
    df = spark.createDataFrame(edges, "source string, parent string, ns int, child string, pageid long")
    roots = spark.createDataFrame([("w", "C0")], "source string, category string")
    assert [(r.pageid, r.level) for r in graph.category_pages(roots, df).collect()] == [(1, n)]
    assert graph.category_pages(roots, df, max_depth=3).count() == 0


def test_category_walk(spark):
    edges = spark.createDataFrame(
        [("w", "A", 14, "B", None), ("w", "B", 14, "A", None), ("w", "B", 0, "p", 1), ("w", "A", 0, "p", 1), ("w", "B", 0, "r", 2), ("w", "Z", 0, "n", 3)],
        "source string, parent string, ns int, child string, pageid long",
    )
    roots = spark.createDataFrame([("w", "A")], "source string, category string")
    rows = graph.category_pages(roots, edges).orderBy("pageid").collect()
    assert [(r.pageid, r.level, r.category) for r in rows] == [(1, 0, "A"), (2, 1, "B")]
    assert graph.category_pages(roots, edges, max_pages=1).count() == 1
    assert graph.category_pages(roots.limit(0), edges).count() == 0


def test_wiki_source(spark):
    def fetch(url, p):
        if p.get("list"):
            if p["cmtitle"] == "bad":
                raise OSError
            if p["cmtitle"] == "half" and "cmcontinue" in p:
                return json.loads("<html>")
            if "cmcontinue" in p:
                return {"query": {"categorymembers": [{"ns": 0, "title": "t2", "pageid": 2}]}}
            return {"query": {"categorymembers": [{"ns": 14, "title": "c", "pageid": 9}]}, "continue": {"cmcontinue": "x"}}
        return {"query": {"pages": {str(p["pageids"]): {"title": "T", "extract": "x" * p["pageids"]}}}}

    categories = spark.createDataFrame([("w", "u", "A"), ("w", "u", "bad")], "source string, api_url string, category string")
    found = wiki.category_members(categories, fetch, 0).orderBy("ns").collect()
    assert [(r.ns, r.child, r.pageid) for r in found] == [(0, "t2", 2), (14, "c", 9)]
    half = wiki.category_members(spark.createDataFrame([("w", "u", "half")], categories.schema), fetch, 0).collect()
    assert [r.pageid for r in half] == [9]  # what was read before it failed
    pages = spark.createDataFrame([("w", 299), ("w", 300), ("x", 400)], "source string, pageid long")
    apis = spark.createDataFrame([("w", "u")], "source string, api_url string")
    assert [r.pageid for r in wiki.page_texts(pages, apis, fetch=fetch, delay=0).collect()] == [300]


def test_distinct_pages(spark):
    df = spark.createDataFrame([(2, "http://A/x/", "b"), (1, "http://a/x", "a"), (3, "http://a/y", None)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.url) for r in crawl.distinct_pages(df).collect()) == [(1, "http://a/x"), (3, "http://a/y")]
    assert crawl.distinct_pages(df.where(F.lit(False))).count() == 0
