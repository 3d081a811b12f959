from pyspark.sql import functions as F

from folioscope.llm import line_dedup as ld

SCHEMA = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_boilerplate_goes_and_content_stays(spark):
    rows = [(i, "http://a.b/x", f"<p>Menu</p><p>own {i}</p>") for i in range(5)] + [(9, "http://c.d", "<p>Menu</p>")]
    got = {r.page_id: r for r in ld.page_line_dedup(pages(spark, rows)).collect()}
    assert [got[i].text for i in range(5)] == [f"own {i}" for i in range(5)]
    assert (got[0].n_lines, got[0].n_dropped, got[0].host) == (2, 1, "a.b")
    assert got[9].text == "Menu"  # one page is no evidence


def test_odd_rows(spark):
    rows = [(None, None, None), (1, None, "<p>x</p>"), (1, None, "<p>x</p>"), (2, "no url", ""), (3, "http://u@H.x:8/", "a\nb\r\n<br>a")]
    got = ld.page_line_dedup(pages(spark, rows)).collect()
    assert len(got) == 5
    assert sorted((r.page_id or 0, r.n_lines, r.text, r.host) for r in got) == [(0, 0, "", ""), (1, 1, "x", ""), (1, 1, "x", ""), (2, 0, "", ""), (3, 3, "a\nb\na", "h.x")]
    assert ld.page_line_dedup(pages(spark, [])).count() == 0


def test_both_joins_agree(spark):
    docs = spark.createDataFrame([(i, "s" if i % 3 else None, f"top\nline {i}\n\nline {i % 2}", "k") for i in range(60)], "doc_id long, source string, text string, kept string")
    a = ld.document_line_dedup(docs)
    b = ld.document_line_dedup(docs, broadcast_lines=0, salts=4)
    assert a.columns == docs.columns
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert not any("top" in r.text for r in a.collect())


def test_copies_count_once(spark):
    docs = spark.createDataFrame([(i, "s", "same text\nof copies", 1) for i in range(20)] + [(100 + i, "s", f"other {i}", 1) for i in range(20)], "doc_id long, source string, text string, n_chars long")
    got = ld.document_line_dedup(docs)
    assert got.where("text = 'same text\nof copies'").count() == 20
    assert got.where(F.length("text") != F.col("n_chars")).count() == 0


def test_near_copies_count_once(spark):
    """A third of a source are near copies, each with a line of its own; a menu is on all pages."""
    lines = [" ".join(f"copied{i}x{j}" for j in range(20)) for i in range(15)]
    near = [(i, "s", "\n".join(["menu", *lines[:i], f"own line of {i}", *lines[i + 1 :]]), 1) for i in range(7)]
    other = [(100 + i, "s", "menu\n" + " ".join(f"other{i}x{j}" for j in range(30)), 1) for i in range(14)]
    alone = [(200 + i, "t", "\n".join([*lines, f"last line {i}"]), 1) for i in range(5)]
    docs = spark.createDataFrame(near + other + alone, "doc_id long, source string, text string, n_chars long")
    for options in ({}, {"broadcast_lines": 0, "salts": 4}):
        got = {r.doc_id: r.text for r in ld.document_line_dedup(docs, **options).collect()}
        assert got == {i: t.removeprefix("menu\n") for i, _, t, _ in near + other + alone}


def test_native_plan(spark):
    plan = ld.page_line_dedup(pages(spark, [(1, "http://a", "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_very_long_page(spark):
    got = ld.page_line_dedup(pages(spark, [(1, "http://a", "<p>word " * 100_000)])).first()
    assert got.n_lines == 100_000
