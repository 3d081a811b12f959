"""Lexical search, repeated passages and collocations against plain versions, with small limits so that every path is taken."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import collocations, lexical, passages
from folioscope.llm.tokens import WHITE, Splitter

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, term string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def prose(seed, n, vocabulary=40, most=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["ÉtÉ", "É", "Ünï", "the", "The", "a-b", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(n):
        some = rnd.choices(words, weights, k=rnd.randrange(most))
        rows.append((i, "".join(w + rnd.choice([" ", " ", " ", ". ", "\n", "\t", ", "]) for w in some), rnd.choice(["en", "de", None]), "clash"))
    return rows


def odd_rows():
    return [(None, "w1 w2 w3", None, "x"), (None, None, None, None), (900, "", "en", None), (901, None, "en", None), (902, " \t\n", "de", None), (903, "w1 w2", "en", None), (903, "w1 w2", "en", None)]


# --- words ----------------------------------------------------------------------------------


def test_splitter():
    texts = ["a bb\n\nccc", None, "", "  ", "x" * 50 + " " + "y" * 90, "é日 é", "one two three four five six seven"]
    splitter = Splitter(WHITE, lower=False, limit=16)
    got, held = {}, []
    for run in splitter.runs(pa.array(texts)):
        for r, w in zip(run.row.tolist(), run.words(np.arange(len(run.row)))):
            got.setdefault(r, []).append(w.decode())
        assert len(run.data) <= 16 or not run.goes_on or run.last == run.first + 1
        held.append((run.first, run.goes_on))
    assert got == {i: t.split() for i, t in enumerate(texts) if t and t.split()}
    assert any(goes_on for _, goes_on in held)


# --- search ---------------------------------------------------------------------------------


def search(docs, items, k=10):
    found = [(d, Counter(TERM.findall(lowered(t)))) for d, t, *_ in docs]
    n = [sum(c.values()) for _, c in found]
    count, total = sum(x > 0 for x in n), sum(n)
    terms = {}
    for item, text in items:
        terms.setdefault(item, set()).update(TERM.findall(lowered(text)))
    out = []
    for item, own in terms.items():
        scores = []
        for (d, c), size in zip(found, n):
            if size:
                m = 10 + 90 * size * count // total
                w = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * sum(t in x for _, x in found) + 1))) for t in own}
                scores.append((-sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c), d is None, d or 0))
        best = sorted(s for s in scores if s[0] < 0)[:k]
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(best)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "block_pairs"), [(7, 1_000_000), (1 << 14, 4)])
def test_search(spark, window, block_pairs):
    docs = prose(1, 120) + odd_rows() + [(1000, "w3 " * 5000 + "rare", "en", None)]
    items = [(1, "W1 the-rare w7"), (2, None), (3, ""), (None, "w5, w5; É"), (4, "nosuchterm"), (5, "w2 W3"), (5, "w9 ünï Ünï"), (6, "w1"), (7, "日本 a-b")]
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.ranked_search(df, asked, window=window, block_pairs=block_pairs).collect()
    assert sorted(map(tuple, got), key=repr) == search(docs, items)
    assert [f.name for f in lexical.ranked_search(df, asked).schema] == ["item_id", "rank", "doc_id", "score"]


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame(prose(2, 5), DOCS), spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.ranked_search(docs.limit(0), items).count() == 0
    assert lexical.ranked_search(docs, items.limit(0)).count() == 0
    assert lexical.ranked_search(docs, items.select("item_id", F.lit(None).cast("string").alias("text"))).count() == 0


def test_long_documents_do_not_overflow():
    n = np.array([1 << 30, 7], np.int64)
    docs, total = 1 << 40, 1 << 60
    assert lexical.length_part(n, docs, total).tolist() == [10 + 90 * x * docs // total for x in n.tolist()]


# --- passages -------------------------------------------------------------------------------


def passage_rows(rows, k):
    texts = {(d, t) for d, t, *_ in rows if d is not None and t}
    places = {}
    for d, t in texts:
        words = re.split(r"[\x20\x09-\x0D]+", t.strip("\x20\t\n\x0b\x0c\r"))
        for s in range(len(words) - k + 1):
            places.setdefault(tuple(words[s : s + k]), []).append((d, s, t))
    gone = {}
    for own in places.values():
        first = min(own)[:2]
        for d, s, t in own:
            if (d, s) != first:
                gone.setdefault((d, t), set()).update(range(s, s + k))
    out = []
    for d, t, *_ in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        kept = [w for i, w in enumerate(words) if i not in gone.get((d, t), ())]
        out.append((d, len(words), len(words) - len(kept), " ".join(kept)))
    return sorted(out, key=repr)


def repeats(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rnd.choices(words, k=n) for n in (9, 12, 31)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rnd.randrange(4)):
            own += rnd.choices(words, k=rnd.randrange(30)) + (rnd.choice(passage) if rnd.random() < 0.6 else [])
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(own), None, None))
    rows += [(100, " ".join(["ab"] * 40), None, None), (101, " ".join(["ab"] * 15), None, None), (102, rows[5][1], None, None), (103, rows[5][1] + " end", None, None)]
    return rows + odd_rows()


@pytest.mark.parametrize(
    ("hot", "dealing"),
    [(256, {}), (0, {}), (2, {"broadcast_rows": 0}), (256, {"crowd": 1, "share": 1.0}), (256, {"crowd": 3, "share": 1.0, "m": 3})],
)
def test_passages(spark, monkeypatch, hot, dealing):
    monkeypatch.setattr(passages, "HOT", hot)
    rows = repeats(3)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = passages.passage_dedup(df, k=8, **dealing).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in got), key=repr) == passage_rows(rows, 8)


def test_passages_in_parts(monkeypatch):
    """Parts of a long text hold the windows of the whole one."""
    monkeypatch.setattr(passages, "SPAN", 5)
    rnd = random.Random(5)
    text = " ".join(rnd.choices(["a", "bb", "ccc", "d"], k=200))
    batch = pa.record_batch([pa.array([1]), pa.array([0]), pa.array([text])], ["doc_id", "version", "text"])

    def windows(run):
        out = set()
        for b in run(iter([batch])):
            for r in b.to_pylist():
                out |= {(s, r["content"] is None) for s in range(r["start"], r["start"] + r["windows"] - (7 if r["content"] is None else 0))}
        return {s for s, _ in out}

    whole = windows(passages.find_runs(8, 3))
    monkeypatch.setattr("folioscope.llm.tokens.LONG", 64)
    monkeypatch.setattr(passages, "Splitter", lambda *a, **b: Splitter(*a, **b, limit=64))
    assert windows(passages.find_runs(8, 3)) == whole == set(range(193))


def test_passage_digests(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(25)), None, None), (2, "x " + " ".join(f"w{i}" for i in range(20)) + "\n y", None, None), (3, None, None, None)]
    got = {r.doc_id: r for r in passages.kept_digests(spark.createDataFrame(rows, DOCS)).collect()}
    assert (got[2].n_words, got[2].n_removed, got[2].kept_sha256) == (22, 20, hashlib.sha256(b"x y").hexdigest())
    assert got[3].kept_sha256 == hashlib.sha256(b"").hexdigest() and got[1].n_removed == 0
    assert passages.kept_digests(spark.createDataFrame([], DOCS)).count() == 0


def test_window_ranks():
    rnd = np.random.default_rng(1)
    ids = rnd.integers(0, 3, 300)
    for k in (1, 2, 3, 7, 20):
        rank = passages.window_ranks(ids, k)
        own = [tuple(ids[i : i + k].tolist()) for i in range(300 - k + 1)]
        assert len(set(zip(rank.tolist(), own))) == len(set(own)) == len(set(rank.tolist()))


# --- collocations ---------------------------------------------------------------------------


def phrases(rows, least, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            s = min((math.floor(Fraction(2_000_000 * a, f[lang, p[:k]] + f[lang, p[k:]])), k) for k in range(1, len(p)))
            inside = [b for (x, q), b in f.items() if x == lang and len(q) > len(p) and b >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 80 * a for b in inside):
                out.setdefault(lang, []).append((-s[0], -a, " ".join(p).encode(), f[lang, p[: s[1]]], f[lang, p[s[1] :]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


@pytest.mark.parametrize(
    ("options", "together"),
    [({}, 4 << 20), ({"split": 5}, 256), ({"max_words": 4}, 256), ({"max_words": 3, "split": 2}, 4 << 20), ({"max_words": 0}, 1 << 12)],
)
def test_collocations(spark, monkeypatch, options, together):
    monkeypatch.setattr(collocations, "TOGETHER", together)
    rows = prose(7, 150, 12) + odd_rows() + [(2000 + i, "new york city. of the of the of", "en", None) for i in range(12)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = collocations.collocations(df, least=8, **options).collect()
    expected = phrases(rows, 8)
    assert sorted(map(tuple, got)) == expected and len(expected) > 30
    assert sorted(map(tuple, collocations.collocations(df, least=8, top=3, **options).collect())) == phrases(rows, 8, 3)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame(prose(8, 5), DOCS)
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df).count() == 0


def test_fragments_in_parts(monkeypatch):
    """A long text in parts gives the fragments of the whole one."""
    rnd = random.Random(9)
    text = "".join(rnd.choice("abcde") + rnd.choice(["  ", " ", " ", ". "]) for _ in range(400))
    (words,) = Splitter(collocations.SEPARATORS, True).runs(pa.array(["a b c d e"]))
    hashes = collocations.of_lang(words.hash, "en").view(np.int64)
    batch = pa.record_batch([pa.array(["en"]), pa.array([text])], ["lang", "text"])

    class Sent:
        value = collocations.Numbers(hashes, np.array([9, 8, 7, 6, 5]), True)

    def fragments():
        out = Counter()
        for b in collocations.find_fragments(Sent, 1 << 40)(iter([batch])):
            for r in b.to_pylist():
                out[r["pivot"], r["fragment"]] += r["n"]
        return out

    whole = fragments()
    monkeypatch.setattr(collocations, "SPAN", 7)
    assert fragments() == whole
    monkeypatch.setattr(collocations, "Splitter", lambda *a, **b: Splitter(*a, **b, limit=50))
    assert fragments() == whole and sum(whole.values()) > 100


@pytest.mark.parametrize("chunk", [1, 5, 1 << 18])
def test_mining_in_chunks(chunk):
    rows = np.array([[-1, -1, -1, 5, 1, 2, -1], [-1, -1, 3, 5, -1, -1, -1], [-1, -1, -1, 5, 1, -1, -1], [-1, -1, 0, 6, 6, -1, -1]], np.int32)
    batch = passages.batch_of(collocations.FRAGMENTS, [rows[:, 3].astype(np.int64), np.zeros(4, np.int64), collocations.binary_rows(rows), [4, 3, 1, 2]])
    total = Counter()
    for b in collocations.mine(1, chunk)(iter([batch.slice(0, 2), batch.slice(2, 2)])):
        for r in b.to_pylist():
            total[tuple(x for x in list(r.values())[:4] if x >= 0)] += r["f"]
    assert total == {(5, 1): 5, (5, 1, 2): 4, (3, 5): 3, (0, 6): 2, (6, 6): 2, (0, 6, 6): 2}
