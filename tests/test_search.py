import random

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.operators import corpus, index, search, slices
from folioscope.operators.numbering import dense_ids
from folioscope.plans import query as q

TEXTS = ["ЭсМинЕц конвой эсминец", "конвой конвой фрегат", "лес море корабль", "эсминец фрегат", "конвой корабль"]
ANY = [(1, 4.791759), (2, 2.810930), (4, 1.693147), (5, 1.405465)]


@pytest.fixture(scope="module")
def built(spark):
    lines = corpus.corpus_lines(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, line string"))
    at = index.Index.build(lines)
    return index.Index(at.postings.cache(), at.vocab.cache(), at.docs.cache())


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("эсминец && конвой", [(1, 4.791759)]),
        ("эсминец || конвой", ANY),
        ("!конвой", [(3, 0.0), (4, 0.0)]),
        ("эсминец && (конвой || фрегат)", [(1, 4.791759), (4, 3.386294)]),
        ("эсминец конвой", ANY),
        ("лес && фрегат", []),
        ("эсминец конвой && лес", [(1, 3.386294), (4, 1.693147)]),
        ("эсминец & конвой", [(1, 3.386294), (4, 1.693147)]),
        ("!", [(i, 0.0) for i in range(1, 6)]),
        ("()", []),
        ("", []),
        ("эсминец,", [(1, 3.386294), (4, 1.693147)]),
        ("эсминец, && конвой", []),
        ("!!эсминец", [(1, 3.386294), (4, 1.693147)]),
        ("(эсминец && конвой", [(1, 4.791759)]),
        ("-- && конвой", []),
    ],
)
def test_search(built, text, expected):
    found = [(r.docid, round(r.score, 6)) for r in search.search(built, text).collect()]
    assert found == expected


def test_top(built):
    assert [r.docid for r in search.search(built, "эсминец конвой", 2).collect()] == [1, 2]


@pytest.mark.parametrize(
    ("text", "node"),
    [
        ("a && b || c", q.Either(q.Both(q.Term("a"), q.Term("b")), q.Term("c"))),
        ("a || b && !c", q.Either(q.Term("a"), q.Both(q.Term("b"), q.Not(q.Term("c"))))),
        ("a b && c", q.Term("a")),
        ("(a b) && c", q.Term("a")),  # b stands where ) is missing, so the rest does not count
        ("a &&", q.Both(q.Term("a"), q.Term(""))),
        ("_A-b_ || x", q.Either(q.Term("a-b"), q.Term("x"))),
        ("a | b", q.Term("a")),
    ],
)
def test_parse(text, node):
    assert q.parse(text) == node


def test_scoring_terms():
    assert q.scoring_terms(q.parse("a && !(b && !c) || !!a")) == ["a", "c"]


nodes = st.recursive(
    st.sampled_from(["эсминец", "конвой", "лес", "фрегат", "нет"]).map(q.Term),
    lambda n: st.one_of(n.map(q.Not), st.builds(q.Both, n, n), st.builds(q.Either, n, n)),
    max_leaves=4,
)


def written(n):
    if isinstance(n, q.Term):
        return n.text
    if isinstance(n, q.Not):
        return f"!({written(n.of)})"
    return f"({written(n.left)}) {'&&' if isinstance(n, q.Both) else '||'} ({written(n.right)})"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(nodes)
def test_flags_equal_sets(built, node):
    text = written(node)
    if not q.has_operators(text):
        text = f"({text})"
    assert q.parse(text) == node
    by_flags = sorted(r.docid for r in search.search(built, text).collect())
    assert by_flags == sorted(r.docid for r in search.hits_by_sets(built, node).collect())


def test_write_and_read(built, spark, tmp_path):
    built.write(str(tmp_path))
    again = index.Index.read(spark, str(tmp_path))
    assert [r.docid for r in search.search(again, "эсминец || конвой").collect()] == [1, 2, 4, 5]
    plan = again.postings.where("term = 'лес'").select("docid")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term" in plan


def test_lines(spark):
    df = spark.createDataFrame([(5, "a\r b"), (2, " \t"), (9, "\r"), (70000, "c")], "doc_id long, line string")
    lines = corpus.corpus_lines(df)
    numbered = corpus.numbered_lines(lines).select("docid", "line")
    assert sorted(map(tuple, numbered.collect())) == [(1, "a b"), (2, "c")]


@pytest.mark.parametrize("step", [7, 10**12])
def test_dense_ids_over_ranges(spark, step):
    keys = list(range(0, 143 * step, step))
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    got = {r.k: r.n for r in dense_ids(df, [F.col("k")], "n").collect()}
    assert got == {k: i + 1 for i, k in enumerate(keys)}


def test_repeated_and_null_keys_have_numbers_of_their_own(spark):
    """Each line one docid, dense and in order of key; lines of one key, equal ones too, are told apart."""
    rows = [(1, "a b"), (1, "c"), (None, "d a"), (1, "c"), (None, "a"), (-5, "e"), (10**17, "a a")] + [(7, f"x{i}") for i in range(40)]
    lines = corpus.corpus_lines(spark.createDataFrame(rows, "doc_id long, line string").repartition(3))
    got = corpus.numbered_lines(lines).orderBy("docid").collect()
    assert [r.docid for r in got] == list(range(1, len(rows) + 1))
    assert [r.doc_id for r in got] == [-5, 1, 1, 1, *[7] * 40, 10**17, None, None]
    assert sorted(r.line for r in got) == sorted(t for _, t in rows)
    assert corpus.numbered_lines(lines.limit(0)).count() == 0
    built, some = index.Index.build(lines), index.Index.of_terms(lines, ["a"])
    both = [sorted(map(tuple, search.search(at, "a").collect())) for at in (built, some)]
    assert both[0] == both[1] and len(both[0]) == 4
    assert {r.docid for r in some.docs.collect()} == set(range(1, len(rows) + 1)) == {r.docid for r in built.docs.collect()}


def test_postings_against_a_loop(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice("ab cd efg h é".split()) for _ in range(rnd.randint(0, 30)))) for i in range(60)]
    lines = spark.createDataFrame([(*r, r[0] + 1) for r in rows], "doc_id long, line string, docid long")
    expected = {}
    for i, text in rows:
        for pos, t in enumerate(x for x in text.split() if x != "é"):
            expected.setdefault((t, i + 1), []).append(pos)
    got = {(r.term, r.docid): (r.tf, r.positions) for r in index.postings(lines).collect()}
    assert got == {k: (len(v), v) for k, v in expected.items()}
    plan = index.postings(lines)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    stems = index.token_stems(lines.limit(3))
    assert stems.columns == ["docid", "pos", "stem"] and stems.count() == index.tokens(lines.limit(3)).count()


def sliced_lines(spark, step=1):
    """Numbered lines in two parts, with lines without tokens, and with docids that are consecutive or not."""
    rnd = random.Random(4)
    rows = [(i * step + 1, " ".join(rnd.choice("ab cd efg h Жук a-b".split()) for _ in range(rnd.choice([0, 3, 40, 200])))) for i in range(300)]
    return spark.createDataFrame(rows, "docid long, line string").repartition(2)


def test_postings_come_in_runs_of_terms(spark):
    rows = index.postings(sliced_lines(spark).repartition(1).sortWithinPartitions("docid")).collect()
    assert [(r.term, r.docid) for r in rows] == sorted((r.term, r.docid) for r in rows)


def test_each_distinct_token_is_stemmed_once(monkeypatch):
    asked = []
    monkeypatch.setattr(slices, "stem", lambda t: asked.append(t) or t[:2])
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 9]), pa.array([["лес", "леса", "лес"], [], ["лес", "x"]])], ["docid", "tokens"])
    rows = [r for b in slices.stem_rows(iter([batch])) for r in b.to_pylist()]
    assert rows == [{"docid": d, "pos": p, "stem": t} for d, p, t in [(5, 0, "ле"), (5, 1, "ле"), (5, 2, "ле"), (9, 0, "ле"), (9, 1, "x")]]
    assert sorted(asked) == ["x", "лес", "лес", "леса"]  # docids 5 and 6 are one slice, 9 another


def test_slices_hold_whole_lines_with_consecutive_docids(monkeypatch):
    monkeypatch.setattr(slices, "SLICE", 4)
    lists = [["a", "b"], ["a"], [], ["c"] * 9, ["a", "b"], ["b"], ["d"] * 4]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5, 7, 6]), pa.array(lists)], ["docid", "tokens"])
    own = [(d.tolist(), t.to_pylist()) for d, _, t in slices.slices(batch)]
    assert own == [([1, 2, 3], ["a", "b", "a"]), ([4], ["c"] * 9), ([5], ["a", "b"]), ([7], ["b"]), ([6], ["d"] * 4)]


@pytest.mark.parametrize("step", [1, 3])
def test_offsets_of_lines(spark, step):
    lines = sliced_lines(spark, step)
    assert sorted(map(tuple, index.line_offsets(lines).collect())) == sorted(map(tuple, index.vocab_offsets(index.postings(lines)).collect()))


@pytest.mark.parametrize("step", [1, 3])
def test_gaps_of_lines(spark, step):
    lines = sliced_lines(spark, step)
    gaps = index.line_gaps(lines)
    assert sorted(map(tuple, gaps.collect())) == sorted(map(tuple, index.posting_gaps(index.counts(lines)).collect()))
    assert index.line_gaps(lines.limit(0)).count() == 0


def test_position_gaps_of_lines(spark):
    lines = sliced_lines(spark)
    assert sorted(map(tuple, index.line_position_gaps(lines).collect())) == sorted(map(tuple, index.position_gaps(index.postings(lines)).collect()))


def test_gaps_over_cells(spark, monkeypatch):
    monkeypatch.setattr(index, "CELL_BITS", 3)
    rows = [(t, d) for t in "ab" for d in (1, 2, 7, 8, 9, 31, 32, 1000)]
    gaps = index.posting_gaps(spark.createDataFrame(rows, "term string, docid long"))
    assert sorted((r.term, r.docid, r.gap) for r in gaps.collect()) == [(t, d, g) for t in "ab" for d, g in zip((1, 2, 7, 8, 9, 31, 32, 1000), (1, 1, 5, 1, 1, 22, 1, 968))]
    assert sorted(map(tuple, index.gaps_to_docids(gaps).collect())) == rows


def test_gaps_round_trip(built):
    post = built.postings.select("term", "docid", "tf")
    gaps = index.posting_gaps(post)
    ordered = gaps.join(post, ["term", "docid"]).select("term", "docid", "gap")
    assert sorted(map(tuple, index.gaps_to_docids(ordered).collect())) == sorted((r.term, r.docid) for r in post.collect())


def test_offsets(built):
    rows = index.vocab_offsets(built.postings.withColumn("tf", F.col("tf"))).orderBy("term").collect()
    at = 0
    for r in rows:
        assert r.offset == at
        at += r.bytes


def test_offsets_over_cells(spark, monkeypatch):
    monkeypatch.setattr(index, "CELL_BITS", 3)
    size = lambda n: 1 if n < 128 else 2 if n < 16_384 else 3
    lists = {t: {d: sorted({d % 5, 7, 200 + d}) for d in (1, 2, 7, 8, 9, 31, 300, 40_000)} for t in ("a", "ab", "b")}
    lists["ab"] = {900: [3]}
    rows = [(t, d, len(p), p) for t, own in lists.items() for d, p in own.items()]
    post = spark.createDataFrame(rows, "term string, docid long, tf long, positions array<int>")
    gaps = lambda ns: [b - a for a, b in zip([0, *ns], ns)]
    expected, at = [], 0
    for t, own in lists.items():
        n = size(len(own)) + sum(map(size, gaps(list(own)))) + sum(size(len(p)) + sum(map(size, gaps(p))) for p in own.values())
        expected.append((t, len(own), n, at))
        at += n
    found = index.vocab_offsets(post).select("term", "df", "bytes", "offset")
    assert sorted(map(tuple, found.collect())) == expected


def test_term_filter_is_below_the_aggregate(spark):
    lines = corpus.corpus_lines(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, line string"))
    plan = index.lexicon(lines, ["лес"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("filter(")


def test_a_lookup_opens_the_files_of_its_terms(spark, tmp_path):
    rows = [(i, " ".join(f"t{(i * k) % 97:02d}" for k in range(1, 12)) + " common") for i in range(400)]
    lines = spark.createDataFrame(rows, "doc_id long, line string")
    kept = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small parts stay apart
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        at = index.Index.build(lines)
        at.write(str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept[0])
        spark.conf.set("spark.sql.shuffle.partitions", kept[1])
    whole = index.Index.read(spark, str(tmp_path))
    every = len(whole.postings.inputFiles())
    assert every >= 10 and whole.vocab.columns == ["term", "df", "first", "last"]
    some = index.Index.read_terms(spark, str(tmp_path), ["t33"])
    assert 1 <= len(some.postings.inputFiles()) <= 2 and some.postings.where("term = 't33'").count() == whole.postings.where("term = 't33'").count()
    for absent in (["t335"], ["zzz"], [""], []):
        assert index.Index.read_terms(spark, str(tmp_path), absent).postings.inputFiles() == []
    for query in ("t33 && (t07 || !common)", "t01 t335", "!t05", "nothing", "common"):
        found = search.search_path(spark, str(tmp_path), query)
        assert found.collect() == search.search(at, query).collect()
