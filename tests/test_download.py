import json
import os

import pyarrow as pa
import pytest

from folioscope.sources import download, wiki
from folioscope.sources.files import read_records, write_pages_array, write_pages_list
from folioscope.sources.shared import LineRange, arrow_schema, filesystem, line_ranges, lines_of, listed

PAGES = "pageid long, title string, lang string, source string"


def counting(log, stop_at=None, fails=()):
    """A fake API: notes each page asked for, breaks the task at ``stop_at``, and does not answer for ``fails``."""

    def fetch(url, p):
        with open(log, "a") as f:
            f.write(f"{p.get('pageids', p.get('cmtitle'))}\n")
        if p.get("list"):
            return {"query": {"categorymembers": [{"ns": 0, "title": f"{p['cmtitle']} page", "pageid": 7}, {"ns": 14, "title": "sub"}]}}
        if p["pageids"] == stop_at:
            raise RuntimeError("cut off")
        if p["pageids"] in fails:
            raise OSError
        return {"query": {"pages": {str(p["pageids"]): {"title": f"T{p['pageids']}", "extract": "é" * p["pageids"]}}}}

    return fetch


def asked(log):
    if not os.path.exists(log):
        return []
    with open(log) as f:
        own = sorted(f.read().split())
    os.remove(log)
    return own


def pages_of(spark, ids):
    return spark.createDataFrame([(i, "t", "fr", "w") for i in ids] + [(1, "t", "de", "unknown"), (None, "t", "fr", "w")], PAGES)


def test_a_second_run_asks_for_nothing(spark, tmp_path):
    path, log = str(tmp_path / "corpus"), str(tmp_path / "log")
    apis = spark.createDataFrame([("w", "http://w")], "source string, api_url string")
    run = lambda ids, **x: download.download(pages_of(spark, ids), apis, path, least=5, fetch=counting(log, **x), delay=0, per_file=2, tasks=2)
    assert download.read_corpus(spark, path).count() == 0
    run([3, 5, 6, 7, 8, 8], fails=[7])
    assert asked(log) == ["3", "5", "6", "7", "8"]
    assert sorted(map(tuple, download.read_corpus(spark, path).collect())) == [(i, f"T{i}", "fr", "w", "é" * i) for i in (5, 6, 8)]
    assert {(r.pageid, r.outcome) for r in download.progress(spark, path).collect()} == {(3, "short"), (5, "kept"), (6, "kept"), (7, "failed"), (8, "kept")}
    run([3, 5, 6, 7, 8])
    assert asked(log) == ["7"]  # the one that failed, and neither the kept ones nor the short one
    run([3, 5, 6, 7, 8])
    assert asked(log) == []
    run([3, 5, 6, 7, 8, 9])
    assert asked(log) == ["9"]
    assert sorted(r.pageid for r in download.read_corpus(spark, path).collect()) == [5, 6, 7, 8, 9]
    runs = [json.loads((tmp_path / "corpus/runs" / f).read_text()) for f in os.listdir(tmp_path / "corpus/runs")]
    assert sum(r["kept"] for r in runs) == 5 and sum(r["failed"] for r in runs) == 1
    assert read_records(spark, f"{path}/batches").count() == 5


def test_a_run_that_is_cut_off(spark, tmp_path):
    path, log = str(tmp_path / "corpus"), str(tmp_path / "log")
    apis = spark.createDataFrame([("w", "http://w")], "source string, api_url string")
    run = lambda **x: download.download(pages_of(spark, range(300, 520)), apis, path, fetch=counting(log, **x), delay=0, per_file=10, seconds=0, tasks=1)
    with pytest.raises(Exception, match="cut off"):
        run(stop_at=444)
    first = asked(log)
    settled = {str(r.pageid) for r in download.progress(spark, path).collect()}
    assert "444" in first and settled and settled < set(first)
    # A file without its progress file is as if it were not there.
    (tmp_path / "corpus/batches/batch-x.jsonl").write_text(json.dumps({"pageid": 444, "source": "w", "text": "half"}) + "\n")
    run()
    again = asked(log)
    assert not settled & set(again) and settled | set(again) == {str(i) for i in range(300, 520)}
    rows = download.read_corpus(spark, path).collect()
    assert sorted(r.pageid for r in rows) == list(range(300, 520)) and {len(r.text) - r.pageid for r in rows} == {0}


def test_a_task_takes_the_place_of_a_lost_one(spark, tmp_path):
    """What an attempt had settled is counted and not asked for again."""
    log, options = str(tmp_path / "log"), {"path": str(tmp_path / "c"), "least": 1, "delay": 0, "perfile": 1}
    rows = [{"pageid": i, "title": None, "lang": None, "source": "w", "api_url": "u"} for i in (4, 5, 6)]

    class Context:
        @staticmethod
        def get():
            return Context()

        def partitionId(self):
            return 3

    batches = lambda own: iter([pa.RecordBatch.from_pylist(own, arrow_schema(download.ASKED))])
    with pytest.MonkeyPatch.context() as m:
        m.setattr(download, "TaskContext", Context)
        writer = download.BatchWriter(options, counting(log))
        writer.write(batches(rows[:2]))
        assert asked(log) == ["4", "5"]
        done = writer.write(batches(rows))
    assert asked(log) == ["6"] and done.counts["kept"] == 3 and len(done.files) == 3
    writer.commit([done, None])
    assert sorted(r.pageid for r in download.read_corpus(spark, options["path"]).collect()) == [4, 5, 6]


def test_overwriting_is_refused(spark, tmp_path):
    spark.dataSource.register(download.CorpusDownload)
    df = spark.createDataFrame([], download.ASKED)
    with pytest.raises(Exception, match="only added"):
        df.write.format("corpus_download").mode("overwrite").save(str(tmp_path / "c"))


def test_line_ranges(tmp_path):
    text = b"".join(b"x" * n + b"\n" for n in (0, 5, 1, 30, 0, 0, 7)) + b"no end"
    (tmp_path / "a").write_bytes(text)
    files, root = filesystem(str(tmp_path))
    for step in (1, 3, 8, 1000):
        parts = line_ranges(listed(files, root), step)
        assert b"".join(line for p in parts for line in lines_of(files, p)) == text
    assert list(lines_of(files, LineRange(f"{root}/a", 2, 6))) == []


def test_sources(spark, tmp_path):
    """Both sources through the reader, over lists as the library writes them."""
    log = str(tmp_path / "log")

    class Texts(wiki.PageTexts):
        fetch = staticmethod(counting(log, fails=[400]))

    class Members(wiki.CategoryMembers):
        fetch = staticmethod(counting(log))

    spark.dataSource.register(Texts)
    spark.dataSource.register(Members)
    pages = pages_of(spark, [299, 300, 301, 400])
    for name, write in (("lines", write_pages_list), ("array", write_pages_array)):
        write(pages.where("pageid is not null"), str(tmp_path / name))
        df = spark.read.format("page_texts").options(apis=json.dumps({"w": "http://w"}), delay=0, rangeBytes=40).load(str(tmp_path / name))
        assert df.rdd.getNumPartitions() > 3
        got = {r.pageid: r for r in df.collect()}
        assert {i: r.outcome for i, r in got.items()} == {299: "short", 300: "kept", 301: "kept", 400: "failed"}
        assert (got[301].lang, got[301].title, len(got[301].text), got[400].text) == ("fr", "T301", 301, None)
        assert asked(log) == ["299", "300", "301", "400"]
    categories = spark.createDataFrame([("w", "u", "A"), ("w", "u", "B")], "source string, api_url string, category string")
    categories.write.json(str(tmp_path / "categories"))
    found = spark.read.format("category_members").option("delay", 0).load(str(tmp_path / "categories"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("w", c, ns, child, i) for c in "AB" for ns, child, i in ((0, f"{c} page", 7), (14, "sub", None))], key=repr)


def test_a_stream_goes_on_from_its_offset(spark, tmp_path):
    log, pages, out = str(tmp_path / "log"), tmp_path / "pages", str(tmp_path / "out")
    pages.mkdir()

    class Texts(wiki.PageTexts):
        fetch = staticmethod(counting(log))

    spark.dataSource.register(Texts)

    def run(name, ids):
        (pages / name).write_text("".join(json.dumps({"pageid": i, "lang": "fr", "source": "w"}) + "\n" for i in ids))
        stream = spark.readStream.format("page_texts").options(apis=json.dumps({"w": "http://w"}), delay=0, least=1).load(str(pages))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        query.awaitTermination(120)
        return asked(log)

    assert run("list-1", [11, 12]) == ["11", "12"]
    assert run("list-2", [13]) == ["13"]  # a new query on the same checkpoint: what came since
    assert sorted(r.pageid for r in spark.read.parquet(out).collect()) == [11, 12, 13]
