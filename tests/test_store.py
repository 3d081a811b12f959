import os

import pytest
from pyspark.sql import functions as F

from folioscope.operators import crawl
from folioscope.sources import http, store
from folioscope.streaming.crawl import crawl_store

NOW, LATER = 1000, 100


def state(spark, *rows):
    return spark.createDataFrame([tuple(({"source": "s", "next_crawl_at": 0, "status": "new"} | r).get(c) for c in crawl.COLUMNS) for r in rows], crawl.STATE)


def urls(df):
    return {r.url: r.status for r in df.collect()}


def test_versions(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.read_store(spark, path).count() == 0 and store.versions(path) == []
    rows = [{"url": f"u{i}", "html": "x" * i} for i in range(50)] + [{"url": None}]
    assert store.upsert(state(spark, *rows), path, buckets=7) == 1
    assert store.read_store(spark, path).count() == 51
    assert store.upsert(state(spark, {"url": "u3", "status": "done", "fetched_at": 1}, {"url": "u3", "status": "error", "fetched_at": 9}, {"url": "new"}), path) == 2
    now = urls(store.read_store(spark, path))
    assert len(now) == 52 and now["u3"] == "error" and now["new"] == "new"
    assert urls(store.read_store(spark, path, 1))["u3"] == "new" and store.versions(path) == [1, 2]
    assert sum(r[2] for r in store.manifest(path).files) == 53  # versions share files
    assert store.compact(spark, path) == 3
    assert urls(store.read_store(spark, path)) == now and sum(r[2] for r in store.manifest(path).files) == 52
    columns = store.read_store(spark, path, columns=["status", "url"])
    assert columns.columns == ["status", "url"] and urls(columns) == now
    long = [r.html for r in store.read_store(spark, path).where("url = 'u49'").collect()]
    assert long == ["x" * 49]


def test_a_failed_write_leaves_the_store(spark, tmp_path):
    path = str(tmp_path / "store")
    store.upsert(state(spark, *({"url": f"u{i}"} for i in range(20))), path)
    files = set(os.listdir(f"{path}/data"))

    @F.udf("string")
    def breaks(url):
        if url == "u7":
            raise ValueError("broken row")
        return "done"

    with pytest.raises(Exception, match="broken row"):
        store.upsert(store.read_store(spark, path).withColumn("status", breaks("url")), path)
    assert urls(store.read_store(spark, path)) == {f"u{i}": "new" for i in range(20)} and store.versions(path) == [1]
    # Of two writes that stand on one version the second is refused, and takes its files away again.
    store.upsert(state(spark, {"url": "a"}), path, base=1)
    before = set(os.listdir(f"{path}/data"))
    with pytest.raises(Exception, match="this write began at 1"):
        store.upsert(state(spark, {"url": "b"}), path, base=1)
    assert set(os.listdir(f"{path}/data")) == before > files
    assert "b" not in urls(store.read_store(spark, path))


def test_a_url_is_looked_up_in_its_bucket(spark, tmp_path):
    path = str(tmp_path / "store")
    store.upsert(state(spark, *({"url": f"u{i}"} for i in range(40))), path, buckets=8)
    schema = spark.createDataFrame([], crawl.STATE).schema
    assert len(store.StoreReader({"path": path}, schema).partitions()) == 8
    (own,) = store.StoreReader({"path": path, "url": "u5"}, schema).partitions()
    assert own.number == store.bucket_of("u5", 8)
    df = store.lookup(spark, path, "u5")
    assert df.rdd.getNumPartitions() == 1 and urls(df) == {"u5": "new"}
    assert store.lookup(spark, path, "nowhere").count() == 0
    store.upsert(state(spark, {"url": "u5", "status": "done"}), path)
    assert urls(store.lookup(spark, path, "u5")) == {"u5": "done"}


def test_crawl(spark, tmp_path):
    path = str(tmp_path / "store")
    store.upsert(state(spark, *({"url": f"http://h{i % 3}/{i}"} for i in range(11)), {"url": "http://h/later", "status": "done", "next_crawl_at": 10**12}), path)
    get = lambda url, headers: (500, "", {}) if url.endswith("/7") else (200, url, {"ETag": "E"})
    fetch = lambda q: http.fetch_pages(q, get, 0, 3)
    assert crawl_store(spark, path, fetch, LATER, max_documents=4, a_round=3, clock=lambda: NOW) == 4
    assert store.read_store(spark, path).where("fetched_at is not null").count() == 4 and store.versions(path) == [1, 2, 3]
    assert crawl_store(spark, path, fetch, LATER, a_round=4, clock=lambda: NOW) == 7
    after = urls(store.read_store(spark, path))
    assert len(after) == 12 and after["http://h1/7"] == "error" and set(after.values()) == {"done", "error"}
    assert crawl_store(spark, path, fetch, LATER, clock=lambda: NOW) == 0
