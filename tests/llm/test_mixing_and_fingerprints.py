import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import fingerprints as fp
from folioscope.llm import mixing
from folioscope.llm.words import Words

SCHEMA = "doc_id long, text string, source string, size long"


def targets_by_resharing(sizes, names, most=3.0):
    """The rule itself: share, stop at the bound, share the excess again."""
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted((n for n in names if n is not None), key=lambda x: x.encode()) + [None] * (None in names))}
    target, full, left = {}, set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / total for s in open_} if total else {}
        over = [s for s in open_ if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            full.add(s)


@pytest.fixture(scope="module")
def mixable(spark):
    rnd = random.Random(8)
    rows = []
    for source, n in (("a", 300), ("b", 3), ("c", 2), ("z", 40), (None, 25), ("é", 0)):
        rows += [(len(rows) + i, " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.randint(1, 60))), source, 1) for i in range(n)]
    rows += [(9000, None, "a", 1), (9001, " \t", "a", 1), (9002, "", "empty", 1), (None, "one two", "a", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_and_bounds(mixable):
    got = mixing.mix_sources(mixable).join(mixable.select("doc_id", "source"), "doc_id").collect()
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
    sizes["a"] += 2  # the row without an id
    expected = targets_by_resharing(sizes, list(sizes))
    for s, t in expected.items():
        assert target[s] == pytest.approx(t)
        if s not in ("a", "b", "c"):
            assert abs(taken[s] - t) <= 0.02 * t + 2
    assert {s for s, t in expected.items() if t == 3 * sizes[s] and t} >= {"b", "c"}


def test_reruns_agree_and_rows_come_back(mixable):
    one = {r.doc_id: r.taken for r in mixing.mix_sources(mixable).collect()}
    assert one == {r.doc_id: r.taken for r in mixing.mix_sources(mixable.repartition(7)).collect()}
    copies = mixing.mixed(mixable, broadcast_rows=0)
    assert copies.columns == mixable.columns
    n = {r.doc_id: r.n for r in copies.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    size = {r.doc_id: r["size"] for r in mixing.mix_sources(mixable).collect()}
    assert all(n.get(i, 0) * size[i] == t for i, t in one.items())
    assert mixing.mix_sources(mixable.limit(0)).count() == 0
    assert mixing.mixed(mixable.limit(0)).count() == 0


def plain_copies(rows, target, most=3.0):
    """The rules for one source by a loop: rows of (u, size) to copies, and each row's share."""
    digits = [len(bin(s)) - 2 if s else 0 for _, s in rows]
    low, high = 0.0, most
    for _ in range(200):  # the level by halving
        level = (low + high) / 2
        low, high = (low, level) if sum(min(d * level, most) * s for d, (_, s) in zip(digits, rows)) > target else (level, high)
    share = [min(d * high, most) for d in digits]
    copies = [int(x + 1e-6) for x in share]
    left = target - sum(c * s for c, (_, s) in zip(copies, rows))
    part = [x - c for x, c in zip(share, copies)]
    ranked = sorted((u / (1 - u) / (p / (1 - p)), i) for i, ((u, _), p) in enumerate(zip(rows, part)) if p > 1e-6)
    sample = 0
    for _, i in ranked:
        if rows[i][1] > left:
            break
        copies[i], left, sample = copies[i] + 1, left - rows[i][1], sample + 1
    later = [i for _, i in ranked[sample:]]
    if later and abs(rows[nearest := min(later, key=lambda i: abs(rows[i][1] - left))][1] - left) < left:
        copies[nearest] += 1
    return copies, share


def test_pareto_sample_against_plain_rules(spark, mixable):
    """Copies of each source by a loop over its documents, and the rates at which classes of size are taken."""
    rnd = random.Random(3)
    rows = []
    for source in range(45):  # equal sources, so a third of them have each weight
        sizes = [1, 2, 3, 6, 12, 25, 30, 50, 60, 60] * 30 + [200]
        rows += [(len(rows) + i, " ".join(["w"] * n), f"s{source:03d}", n) for i, n in enumerate(sizes)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    size = {i: n for i, _, _, n in rows}
    got = mixing.with_copies(docs).select("row.doc_id", "row.source", "target", "share", "copies").collect()
    taken, rates = {}, {}
    for r in got:
        taken.setdefault((r.source, r.target), []).append((r.doc_id, r.copies, r.share))
        rates.setdefault((round(r.target), size[r.doc_id]), []).append((r.copies, r.share))
    for (_, target), own in taken.items():
        assert abs(sum(size[i] * n for i, n, _ in own) - target) <= 100  # half of the largest document
    for (_, target), own in list(taken.items())[:12]:
        u = [(int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48 for i, _, _ in own]
        copies, share = plain_copies([(x, size[i]) for x, (i, _, _) in zip(u, own)], target)
        assert np.allclose(share, [x[2] for x in own], atol=1e-6) and copies == [x[1] for x in own]
    for pairs in rates.values():
        copies, share = np.array(pairs).T
        assert abs(copies.mean() - share.mean()) < (0.08 if len(pairs) > 400 else 0.5)
    assert len({s for pairs in rates.values() for _, s in pairs}) > 10  # shares differ by weight and size


def test_cells_change_no_sum(mixable, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 20)
    got = mixing.mix_sources(mixable).join(mixable.select("doc_id", "source"), "doc_id").where("source = 'a'").agg(F.sum("taken"), F.first("target")).first()
    assert abs(got[0] - got[1]) <= 60


def test_words(spark):
    df = spark.createDataFrame([("a\x0bb\x0c c\r\n",), (" ",), ("",), (None,), ("  x",)], "t string")
    assert [r[0] for r in df.select(mixing.n_words(F.col("t"))).collect()] == [3, 1, 0, 0, 1]


@pytest.mark.parametrize("rows_per_range", [1, 3, 1000])
def test_next_documents(spark, rows_per_range):
    texts = {i * 7 - 20: f"text {i} 🙂 " * i for i in range(12)}
    rows = [(d, t, "x", 1) for d, t in texts.items()] + [(1000, None, "x", 1), (1001, "", "x", 1)]
    texts |= {1000: "", 1001: ""}
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in fp.fingerprints(df, rows_per_range=rows_per_range).collect()}
    ids, words = sorted(texts, reverse=True), Words()
    assert sorted(got) == sorted(ids)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        half = len(texts[a]) // 2
        edited = texts[a][: len(texts[a]) - half] + texts[b][:half]
        own, after, following = (fp.fingerprint(t, words) for t in (texts[a], edited, texts[b]))
        r = got[a]
        assert (r.n_chars, r.edited_sha256) == (len(texts[a]), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fp.as_text(own), fp.as_text(after))
        assert (r.near_edited, r.near_next) == (fp.likeness(own, after), fp.likeness(own, following))


def test_odd_fingerprints(spark):
    df = spark.createDataFrame([(None, "a b", "x", 1), (3, "same words here", "x", 1), (3, "same words here", "x", 1), (2, "w " * 100_000, "x", 1)], SCHEMA)
    got = fp.fingerprints(df).collect()
    assert len(got) == 4
    assert sum(r.near_next == 1.0 for r in got) == 1
    one = fp.fingerprints(df.where("doc_id = 2")).first()
    assert one.near_next == 1.0
    assert fp.fingerprints(df.limit(0)).count() == 0


def plain_order_minhash(words):
    """The slots of a list of words, number by number, from the definition alone."""
    whole = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & whole
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & whole
        return x ^ (x >> 31)

    base, tool = 0x9E3779B97F4A7C15, Words()
    raw = [np.frombuffer(w.encode(), np.uint8) for w in words]
    h = [int(tool.hashes(w, np.array([0]), np.array([len(w)]))[0]) for w in raw]
    grams = [mixed((a * base + b) & whole) for a, b in zip(h, h[1:])] if len(h) > 1 else h
    seen, numbered = {}, []
    for g in grams:  # each k-mer with its occurrence number
        numbered.append(mixed((g + seen.get(g, 0) * base) & whole))
        seen[g] = seen.get(g, 0) + 1
    slots = []
    for k in range(1, fp.SLOTS + 1):
        seed = mixed(k * base & whole)

        def rank(i, seed=seed):
            x = ((numbered[i] ^ seed) * base) & whole
            return ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & whole, i

        acc = seed
        for i in sorted(sorted(range(len(numbered)), key=rank)[: fp.KEEP]):  # the smallest, in text order
            acc = mixed((acc * base + numbered[i]) & whole)
        slots.append(acc & 0xFFFFFFFF)
    return slots


def test_order_minhash_against_plain_one():
    rnd = random.Random(12)
    for n in (1, 2, 3, 10, 60):
        words = [rnd.choice("a b c dd the house".split()) for _ in range(n)]
        assert fp.fingerprint("  ".join(words), Words()).tolist() == plain_order_minhash(words)
    assert not len(fp.fingerprint(" \n", Words()))


@pytest.mark.parametrize("rows_per_range", [1, 5])
def test_crowded_and_null_ids_are_sliced(spark, rows_per_range):
    """A third of the rows have one id and a third none; rows are in order of id downwards and of the text's hash."""
    rnd = random.Random(4)
    rows = [(i % 40 * 3, " ".join(rnd.choice("abcdef") for _ in range(9)), "x", 1) for i in range(40)]
    rows += [(60, f"crowd {i} {i * i}", "x", 1) for i in range(40)] + [(None, f"none {i}", "x", 1) for i in range(40)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    order = df.selectExpr("doc_id", "text", "xxhash64(text) as h").collect()
    order = sorted(((r.doc_id is None, -(r.doc_id or 0), r.h), r.text) for r in order)
    _, crowded = fp.quantile_cuts(df, 80, rows_per_range, 1000)
    assert crowded[60] == max(crowded.values()) >= 20 // rows_per_range
    expected = []
    for (_, text), (_, following) in zip(order, order[1:] + order[:1]):
        expected.append(hashlib.sha256(fp.edited(text, following).encode()).hexdigest())
    got = fp.fingerprints(df.withColumn("salt", F.lit(1)).withColumn("range", F.lit(2)), rows_per_range=rows_per_range).collect()
    assert sorted(r.edited_sha256 for r in got) == sorted(expected)


def test_slots_by_definition():
    rnd = np.random.default_rng(2)
    h = rnd.integers(0, 50, 300).astype(np.uint64)
    numbered = fp.occurrence_numbered(h)
    assert len(set(numbered.tolist())) == 300
    moved = fp.order_minhash(np.concatenate([h[150:], h[:150]]))
    assert 0.2 < fp.likeness(fp.order_minhash(h), moved) < 0.95  # the same k-mers in another order
    assert fp.likeness(fp.order_minhash(h), fp.order_minhash(h)) == 1.0


def test_likeness_follows_edits():
    rnd = random.Random(0)
    words = [f"w{rnd.randrange(5000)}" for _ in range(400)]
    tool = Words()
    own = fp.fingerprint(" ".join(words), tool)
    last = 1.0
    for n in (4, 20, 80, 200):
        other = list(words)
        for i in rnd.sample(range(400), n):
            other[i] = "changed" + str(i)
        now = fp.likeness(own, fp.fingerprint(" ".join(other), tool))
        assert now < last
        last = now
