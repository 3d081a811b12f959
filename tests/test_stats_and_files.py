import json
import math

from pyspark.sql import functions as F

from folioscope.functions.text import date_of
from folioscope.operators import search, stats
from folioscope.sources import files

RECORDS = ['{"text":"a"}', "not json", '{"text":""}', '{"x":1}', '{"text":null}', "5", "", '{"text":"b\\nc"}']


def test_records(spark, tmp_path):
    (tmp_path / "batch_0001.jsonl").write_text("\n".join(RECORDS))
    assert sorted(r.text for r in files.read_records(spark, str(tmp_path / "batch_*.jsonl")).collect()) == ["a", "b\nc"]


def test_records_are_added_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "pageid long, text string")
    path = str(tmp_path / "out")
    files.write_records(df.limit(1), path, ["pageid"])
    files.write_records(df, path, ["pageid"])
    assert sorted(r.pageid for r in files.read_records(spark, path, "pageid long, text string").collect()) == [1, 2]


def test_pages_list(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"pageid": 1, "title": "A"},\n {"pageid": 2, "title": "B"}]')
    assert [r.title for r in files.read_pages_list(spark, str(tmp_path / "p.json")).orderBy("pageid").collect()] == ["A", "B"]
    files.write_pages_list(files.read_pages_list(spark, str(tmp_path / "p.json")), str(tmp_path / "q"))
    assert files.read_pages_list(spark, str(tmp_path / "q"), array=False).count() == 2


def test_pages_array(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"T{i}", None, "s") for i in range(30, 0, -1)], files.PAGES).repartition(3)
    files.write_pages_array(pages, str(tmp_path / "a"))
    (part,) = (tmp_path / "a").glob("part-*")
    assert [x["pageid"] for x in json.loads(part.read_text())] == list(range(1, 31))
    assert sorted(map(tuple, files.read_pages_list(spark, str(tmp_path / "a")).collect())) == sorted(map(tuple, pages.collect()))


def test_first_lines_over_splits(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.tsv").write_text("".join(f"t{k}_{i}\t{0 if i == 3 else i + 1}\n" for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = files.read_freqs(spark, str(tmp_path), max_terms=620)
        assert {r.term for r in got.collect()} == {f"t0_{i}" for i in range(500) if i != 3} | {f"t1_{i}" for i in range(120) if i != 3}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_small_helpers(spark):
    df = spark.createDataFrame([(3, 1.5)], "docid long, score double")
    assert search.as_lines(df).first().line == "3\t1.500000"
    words = spark.createDataFrame([("столы\r",), ("",), ("test",)], "line string")
    assert [r.stem for r in stats.stem_lines(words).collect()] == ["стол", "", "test"]
    rates = df.select(stats.per_second(F.col("score"), 0.5).alias("a"), stats.per_second(F.col("score"), 0).alias("b"), date_of(F.lit(86_400)).alias("c"))
    assert tuple(rates.first()) == (3.0, 0.0, "1970-01-02 00:00:00")


def test_lines_end_at_line_feeds(spark, tmp_path):
    (tmp_path / "c.txt").write_bytes(b"a\rb\r\nc\n")
    assert sorted(r.line for r in files.read_lines(spark, str(tmp_path / "c.txt")).collect()) == ["a\rb\r", "c"]
    assert sorted(r.line for r in files.read_token_lines(spark, str(tmp_path / "c.txt")).collect()) == ["a\rb", "c"]


def test_freqs_file(spark, tmp_path):
    df = spark.createDataFrame([("a", 5), ("b", 7)], "term string, cnt long")
    files.write_freqs(df, str(tmp_path / "f"))
    assert sorted(map(tuple, files.read_freqs(spark, str(tmp_path / "f")).collect())) == [("a", 5), ("b", 7)]
    files.write_lines(df, "term", str(tmp_path / "l"))
    assert files.read_lines(spark, str(tmp_path / "l")).count() == 2


def test_config():
    settings = {"logic": {"delay_sec": 0.5, "recrawl_interval_sec": 60}, "seeds": {"type": "pages_list", "base_url": "b", "source_name": "s", "pages_list_path": "p"}}
    assert files.crawl_config(settings).max_documents == 10**9
    settings["seeds"]["type"] = "other"
    try:
        files.crawl_config(settings)
    except ValueError:
        return
    raise AssertionError


def test_stats_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert tuple(stats.corpus_stats(docs).first()) == (0, 0, 0.0, 0, 0.0)
    ranked = stats.ranked_freqs(stats.term_freqs(docs))
    assert tuple(stats.zipf_fit(ranked).first()) == (0.0, 1.0, 0)


def test_zipf(spark):
    freqs = spark.createDataFrame([(f"w{i}", 1000 // i) for i in range(1, 6)], "term string, cnt long")
    ranked = stats.ranked_freqs(freqs)
    assert [r.term for r in ranked.orderBy("rank").collect()] == ["w1", "w2", "w3", "w4", "w5"]
    fit = stats.zipf_fit(ranked).first()
    assert abs(fit.s - 1) < 0.01 and abs(fit.log_c - math.log(1000)) < 0.01 and fit.fit_points == 5
    one = stats.zipf_fit(stats.ranked_freqs(freqs.limit(1))).first()
    assert (one.s, one.fit_points) == (1.0, 1) and abs(one.log_c - math.log(1000)) < 1e-9


def test_ties_rank_by_term(spark):
    freqs = spark.createDataFrame([("b", 2), ("a", 2), ("c", 3), ("ab", 2)], "term string, cnt long")
    assert [(r.rank, r.term) for r in stats.ranked_freqs(freqs).orderBy("rank").collect()] == [(1, "c"), (2, "a"), (3, "ab"), (4, "b")]


def test_stem_freqs(spark):
    docs = spark.createDataFrame([(1, "столы стол test tests")], "doc_id long, text string")
    assert {r.stem: r.cnt for r in stats.stem_freqs(docs).collect()} == {"стол": 2, "test": 1, "tests": 1}


def test_mapped_freqs_takes_any_normal_form(spark):
    freqs = spark.createDataFrame([("A", 1), ("a", 2)], "term string, cnt long")
    assert [tuple(r) for r in stats.mapped_freqs(freqs, F.lower("term")).collect()] == [("a", 3)]
