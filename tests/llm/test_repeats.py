import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import repeats as rp

SCHEMA = "doc_id long, text string, start int"


def brute(rows, n):
    """(doc_id, bytes, removed, spans, sha256 of the rest) by a dictionary of all windows; rows may end in the hash that orders texts of one id."""
    rows = [(*r, 0)[:3] for r in rows]
    first, out = {}, []
    place = {(d, t): (d, h) for d, t, h in rows if d is not None}
    for d, t in sorted(place, key=place.get):
        raw = (t or "").encode()
        for s in range(len(raw) - n + 1):
            first.setdefault(raw[s : s + n], (*place[d, t], s))
    for d, t, _ in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - n + 1 if d is not None else 0):
            if first[raw[s : s + n]] < (*place[d, t], s):
                gone[s : s + n] = True
        gone = gone[:-1]
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed, letters):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    passages = [word(rnd.randint(60, 260)) for _ in range(8)]
    rows = [(i, "".join(rnd.choice([word(rnd.randint(1, 150)), rnd.choice(passages), rnd.choice(passages)[: rnd.randint(90, 200)]]) for _ in range(rnd.randint(0, 7)))) for i in range(120)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("letters", "hot"), [("abcdefghij klmn", 256), ("ab", 256), ("abcdefghij", 1), ("aä€", 2)])
def test_against_brute_force(spark, monkeypatch, letters, hot):
    monkeypatch.setattr(rp, "HOT", hot)
    rows = texts(len(letters), letters)
    rows += [(500, None), (501, ""), (502, "x" * 99), (503, "x" * 100), (504, "x" * 400), (None, rows[0][1]), rows[3], rows[3]]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in rp.repeat_dedup(df).collect()), key=repr)
    assert got == sorted(brute(rows, 100), key=repr)


def test_long_texts_go_in_parts(spark, monkeypatch):
    monkeypatch.setattr(rp, "LONG", 700)
    rows = [(1, "".join(random.Random(2).choice("abcdefgh") for _ in range(5000)))]
    rows.append((2, rows[0][1][600:2600] + "-" + rows[0][1][:90]))
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in rp.repeat_dedup(df, broadcast_ids=0).collect()) == sorted(brute(rows, 100))


def varied_surroundings(n):
    """Texts that have one passage of 150 bytes between words of their own."""
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    passage = word(150)
    return [(i, word(130) + passage + word(130)) for i in range(n)]


def test_no_key_of_many_rows_is_gathered(spark, monkeypatch):
    """The blocks at a passage's ends have a text each under one key: none may reach one task whole."""
    monkeypatch.setattr(rp, "HOT", 8)
    monkeypatch.setattr(rp, "FULL", 20, raising=False)
    whole = rp.later_occurrences

    def bounded(min_bytes):
        inner = whole(min_bytes)

        def run(batches):
            sizes = {}

            def watched():
                for batch in batches:
                    for key, raw in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
                        sizes[key] = sizes.get(key, 0) + (raw is not None)
                    assert max(sizes.values()) <= 20
                    yield batch

            return inner(watched())

        return run

    monkeypatch.setattr(rp, "later_occurrences", bounded)
    rows = varied_surroundings(200)
    got = rp.repeat_dedup(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(rows, 100))


@pytest.mark.parametrize("letters", ["abcdefghij klmn", "ab", "aä€"])
def test_windows_against_brute_force(spark, monkeypatch, letters):
    monkeypatch.setattr(rp, "HOT", 1)
    monkeypatch.setattr(rp, "FULL", 1)
    rows = texts(len(letters), letters) + [(200 + i, t) for i, t in varied_surroundings(40)]
    rows += [(1000, "x" * 400), (1001, "x" * 130), (None, rows[0][1]), rows[3], rows[3]]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in rp.repeat_dedup(df).collect()), key=repr)
    assert got == sorted(brute(rows, 100), key=repr)


def test_one_id_with_several_texts(spark):
    """Documents told by id and text, in order of id and the text's hash; no span of one text is cut from another."""
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    a, b, c = word(144), word(144), word(300)
    rows = [(1, a), (2, a), (2, b), (3, c), (3, b + c[40:200]), (3, c), (4, c[20:250] + b), (None, a), (None, b)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    hashes = [r.h for r in df.selectExpr("xxhash64(text) as h").collect()]
    for options in ({}, {"broadcast_ids": 0}):
        got = rp.repeat_dedup(df, **options).collect()
        assert sorted((tuple(r) for r in got), key=repr) == sorted(brute([(*r, h) for r, h in zip(rows, hashes)], 100), key=repr)
    assert {(r.doc_id, r.n_removed) for r in got if r.n_bytes == 144} == {(1, 0), (2, 144), (2, 0), (None, 0)}


@pytest.mark.parametrize("size", [88, 90, 98, 150])
def test_crowded_anchors_are_dealt_out(spark, size):
    """A phrase in 2,000 texts: its anchors are told from a sample, and no task gathers what they have."""
    rnd = random.Random(size)
    word = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    phrase = word(size)
    rows = [(i, word(60) + phrase + word(60)) for i in range(2000)] + [(5000, word(300)), (5001, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(40)
    keyed = df.selectExpr("doc_id", "xxhash64(text) as version", "text")
    crowded = rp.crowded_anchors(keyed, 100, 0.5, 64)
    anchors = keyed.where("text is not null").mapInArrow(rp.find_segments(100), rp.SEGMENTS).where("content is not null").groupBy("anchor").count()
    rest = anchors.join(crowded, anchors["anchor"] == crowded["_anchor"], "left_anti").agg({"count": "max"}).first()[0]
    assert crowded.count() > 0 and rest < 256
    got = rp.repeat_dedup(df, sample_share=0.5)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(brute(rows, 100), key=repr)


def test_empty(spark):
    assert rp.repeat_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def maximal_by_brute_force(parts, least):
    """Repeats that no occurrence-preserving byte on either side can extend, with their occurrences."""
    out = {}
    for p, part in enumerate(parts):
        for i in range(len(part)):
            for j in range(i + least, len(part) + 1):
                out.setdefault(part[i:j], []).append((p, i))
    found = set()
    for w, places in out.items():
        if len(places) < 2:
            continue
        left = {parts[p][i - 1] if i else (p, i) for p, i in places}
        right = {parts[p][i + len(w)] if i + len(w) < len(parts[p]) else (p, i) for p, i in places}
        if len(left) > 1 and len(right) > 1:
            found.add((len(w), tuple(sorted(places))))
    return found


@pytest.mark.parametrize("seed", range(6))
def test_maximal_repeats(seed):
    rnd = random.Random(seed)
    parts = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 40))) for _ in range(6)]
    parts.append(parts[0])
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    text = np.frombuffer(b"".join(parts), np.uint8)
    got = set()
    for length, positions in rp.maximal_repeats(text, ends, 3):
        places = [(int(np.searchsorted(ends, x, "right")), int(x)) for x in positions]
        got.add((length, tuple(sorted((p, x - int(starts[p])) for p, x in places))))
    assert got == maximal_by_brute_force(parts, 3)


def test_merged():
    doc, start, end = rp.merged(np.array([2, 1, 1, 1]), np.array([0, 5, 0, 20]), np.array([3, 9, 5, 30]))
    assert list(zip(doc.tolist(), start.tolist(), end.tolist())) == [(1, 0, 9), (1, 20, 30), (2, 0, 3)]


def test_no_window_partition_grows_with_the_table(spark):
    """At two sizes of a table with one anchor on all documents, at most 120 segments meet under one key."""
    rnd = random.Random(4)
    letters = lambda n: "".join(rnd.choices("abcdefgh", k=n))
    core = letters(300)
    for n in (400, 1200):
        rows = [(i, 0, letters(80) + core[:120] + letters(80)) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, version long, text string").repartition(8)
        found = docs.mapInArrow(rp.find_segments(100), rp.SEGMENTS)
        most = lambda df: df.where("content is not null").groupBy("anchor", "salt").count().agg(F.max("count")).first()[0]
        assert most(rp.dealt_out(found, None, 1000)) >= n // 4
        crowded = rp.crowded_anchors(docs, 100, 1.0, 120)
        for broadcast in (1000, 0):
            assert most(rp.dealt_out(found, crowded, broadcast)) <= 120
