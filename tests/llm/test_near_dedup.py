import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import near_dedup as nd
from folioscope.llm.components import components
from folioscope.llm.words import mix

SCHEMA = "doc_id long, text string, _gone long"


def shingles(text, k):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k, num=80, den=100):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same_id = rows[i][0] == rows[j][0] and sets[i] and sets[j]
            if sets[i] and sets[j] and (den * both >= num * len(sets[i] | sets[j]) or same_id):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return [(d, len(sets[i]), min(groups[root(i)])) for i, (d, _) in enumerate(rows)]


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 6, 30, 120]))]
        for _ in range(rnd.choice([1, 2, 9])):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            rows.append((n, " ".join(own)))
            n += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_against_brute_force(spark, k):
    rows = corpus(k) + [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "One"), (2004, "oNE"), (2005, "tWO words"), (2006, "É A b c d"), (2007, "é a b c d")]
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = sorted(tuple(r)[:3] for r in nd.near_components(df, k=k).collect())
    assert got == sorted(brute(rows, k))
    kept = nd.near_dedup(df, k=k)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _, c in brute(rows, k) if d == c}


@pytest.mark.parametrize("few", [0, 2, 64])
def test_links_beside_the_star(spark, monkeypatch, few):
    """a-b and c-d are linked, b and c too, but only through documents that are no hub."""
    monkeypatch.setattr(nd, "FEW", few)
    base = [f"x{i}" for i in range(200)]
    chain = []
    for step in range(12):
        own = list(base)
        own[step * 6 : step * 6 + 12] = [f"y{step}.{i}" for i in range(12)]
        chain.append((step, " ".join(own)))
    df = spark.createDataFrame([(*r, 1) for r in chain], SCHEMA)
    assert sorted(tuple(r)[:3] for r in nd.near_components(df, k=4).collect()) == sorted(brute(chain, 4))


def test_no_id_and_repeated_ids(spark):
    rows = [(None, "a b c d e", 1), (None, "a b c d e", 1), (5, "a b c d e", 1), (5, "k l m n o", 1), (7, "k l m n o", 1)]
    got = nd.near_components(spark.createDataFrame(rows, SCHEMA), k=4).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, None, True), (0, None, True), (5, 5, True), (5, 5, True), (7, 5, False)]
    assert nd.near_components(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nd.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_joins_by_id_beyond_the_broadcast_bound(spark):
    rows = corpus(9)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = sorted(tuple(r)[:3] for r in nd.near_components(df, k=5, broadcast_ids=0).collect())
    assert got == sorted(brute(rows, 5))


def test_densified_slots_agree_as_sets_do():
    rnd = np.random.default_rng(4)
    errors = []
    for n, shared in ((10, 8), (60, 48), (500, 400)):
        for _ in range(60):
            h = mix(rnd.integers(1, 2**62, 2 * n).astype(np.uint64))
            a, b = np.sort(h[:n]), np.sort(np.concatenate([h[:shared], h[n : 2 * n - shared]]))
            slots = [nd.signatures(np.zeros(len(x), np.int64), x, 1)[0] for x in (a, b)]
            errors.append((slots[0] == slots[1]).mean() - shared / (2 * n - shared))
    assert abs(np.mean(errors)) < 0.02


def test_large_stars_are_dealt_out(spark, monkeypatch):
    """Copies of one text with a word of their own: their hub's set meets them block by block."""
    monkeypatch.setattr(nd, "MEMBERS", 4)
    rows = [(i, " ".join(f"w{j}" if j != i % 50 else f"own{i}" for j in range(60))) for i in range(60)] + [(100, "something else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bound in (1_000_000, 0):
        got = {r.doc_id: r.component_id for r in nd.near_components(docs, broadcast_ids=bound).collect()}
        assert got == {i: 100 if i == 100 else 0 for i in got} and len(got) == 61
    star = spark.createDataFrame([(1, i) for i in range(2, 42)] + [(50, 51)], "hub long, rep long")
    dealt, hubs = nd.in_blocks(star, 100)
    assert dealt.count() == 41 and dealt.groupBy("hub", "block").count().agg({"count": "max"}).first()[0] < 12
    assert sorted(map(tuple, hubs.collect())) == [(1, i) for i in range(10)] + [(50, 0)]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(1000, 1064)]
    star = [(5, i) for i in range(10, 60)]
    links = spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links, "a", "b").collect()}
    assert got == {i: 1000 for i in range(1000, 1065)} | {i: 5 for i in [5, *range(10, 60)]}
    assert components(links.where(F.lit(False)), "a", "b").count() == 0


@pytest.mark.parametrize("few", [0, 5, 64])
def test_rest_is_whole(spark, monkeypatch, few):
    """All links between members of one star that are in different components, by any pair."""
    monkeypatch.setattr(nd, "FEW", few)
    rnd = random.Random(few)
    base = list(range(60))
    sets = [sorted(set(base[: rnd.randrange(30, 60)]) | {rnd.randrange(60, 80) for _ in range(rnd.randrange(12))}) for _ in range(40)]
    sets += [sorted({x - rnd.randrange(2) for x in s}) for s in sets[:20]]
    comp = [i // 2 for i in range(len(sets))]
    frame = spark.createDataFrame(list(enumerate(sets)), "doc_id long, shingles array<long>")
    star = spark.createDataFrame([(0, i) for i in range(1, len(sets))], "hub long, rep long")
    comps = spark.createDataFrame([(i, c) for i, c in enumerate(comp)], "node long, component long")
    got = {tuple(sorted(r)) for r in nd.rest(star, frame, comps, 80, 100, 1000).collect()}
    good = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if comp[a] != comp[b] and 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))}
    assert got <= good and len(good) > 50
    # Of links between two components one is enough.
    tied = lambda pairs: {tuple(sorted((comp[a], comp[b]))) for a, b in pairs}
    assert tied(got) == tied(good)


def test_a_template_meets_under_few_shingles(spark):
    """Pages of one template with texts of their own: as many as there are, none meets another."""
    words = lambda a, n: [f"{a}.{i}" for i in range(n)]
    rows = [(i, " ".join(words("t", 150) + words(f"d{i}", 60))) for i in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    members = spark.createDataFrame([(i, i) for i, _ in rows], "rep long, comp long")
    sets = df.select("doc_id", "text").mapInArrow(nd.full_sets(4), "doc_id long, shingles array<long>").withColumnRenamed("doc_id", "rep")
    assert nd.rare_shingles(members.join(sets, "rep"), 80, 100).count() == 0
    assert nd.near_components(df, k=4).where("kept").count() == 300
