"""The pipeline's stages against plain versions of the same rules, each on its own input."""

from collections import Counter

import pytest
from test_mixing_and_fingerprints import targets_by_resharing
from test_near_dedup import brute

import corpus_pipeline as cp
from folioscope.llm import encode
from folioscope.llm.common import read
from folioscope.llm.toxicity import toxicity_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, small_sf):
    """The rows before the first stage and after each."""
    docs = read(spark, small_sf, "documents")
    out = [docs]
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, small_sf).cache()
        if name != "sentencepiece":
            assert docs.columns == COLUMNS
        out.append(docs)
    return out


def test_toxicity_stage(spark, small_sf, steps):
    before, after = steps[:2]
    accepted = toxicity_scores(before, read(spark, small_sf, "labels")).where("predicted = 0")
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in accepted.collect())
    assert 0.8 * before.count() < after.count() <= before.count()


def test_line_stage(steps):
    before, after = ({r.doc_id: r for r in x.collect()} for x in steps[1:3])
    texts = {}
    for r in before.values():
        texts.setdefault(r.source, set()).add(r.text)
    bad = {}
    for source, pages in texts.items():
        n = Counter(line for page in pages for line in {x for x in page.split("\n") if x.strip(" \t\x0b\x0c\r")})
        bad[source] = {line for line, k in n.items() if k >= 3 and k > 0.2 * len(pages)}
    assert before.keys() == after.keys() and any(bad.values())
    for i, r in before.items():
        expected = "\n".join(x for x in r.text.split("\n") if x not in bad[r.source])
        assert (after[i].text, after[i].n_chars) == (expected, len(expected))


def test_near_duplicate_stage(steps):
    before, after = (sorted((r.doc_id, r.text) for r in x.collect()) for x in steps[2:4])
    kept = {d for d, _, c in brute(before, 5) if d == c}
    assert after == [r for r in before if r[0] in kept] and len(after) < len(before)


def test_mix_stage(steps):
    before, after = steps[3].collect(), steps[4].collect()
    size = {r.doc_id: len(r.text.split()) for r in before}
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r.source] += size[r.doc_id]
    copies = Counter(r.doc_id for r in after)
    assert max(copies.values()) <= 3
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
    for r in after:
        taken[r.source] += size[r.doc_id]
    largest = {s: max(size[r.doc_id] for r in before if r.source == s) for s in sizes}
    for s, t in targets_by_resharing(dict(sizes), list(sizes)).items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1


def test_encoding_stage(steps):
    spm = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=encode.MODEL)
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    for r in rows:
        assert list(r.ids) == spm.encode(texts[r.doc_id]) and r.round_trip and r.n_ids == len(r.ids)


def test_run_is_the_stages_in_order(spark, small_sf, steps):
    found = cp.run(spark, small_sf)
    key = lambda r: (r.doc_id, tuple(r.ids))
    assert sorted(map(key, found.collect())) == sorted(map(key, steps[-1].collect()))
    assert [name for name, _ in cp.STAGES] == ["toxicity", "line dedup", "near duplicates", "source mix", "sentencepiece"]


def test_empty_documents(spark, small_sf):
    docs = spark.read.parquet(f"{small_sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, small_sf)
    assert docs.count() == 0


def test_odd_rows(spark, small_sf):
    schema = spark.read.parquet(f"{small_sf}/documents.parquet").schema.add("row", "string").add("_size", "long")
    rows = [(None, None, None, None, None, "r", 1), (1, None, "en", "s", 0, "r", 1), (2, "", "en", "s", 0, "r", 1), (3, "a b " * 50_000, "en", None, 5, "r", 1)]
    docs = spark.createDataFrame(rows + rows[3:], schema)
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, small_sf)
        if name == "near duplicates":
            assert docs.count() == 5
            assert docs.columns == schema.fieldNames()
    assert docs.count() >= 1
