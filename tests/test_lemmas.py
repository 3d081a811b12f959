import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.operators import lemmas, stats

PAIRS = [
    ("самолёты", "самолёт"), ("самолётами", "самолёт"), ("аэропорты", "аэропорт"), ("аэропортами", "аэропорт"), ("машины", "машина"), ("шины", "шина"), ("кабины", "кабина"),
    ("машин", "машина"), ("порт", "порт"), ("борт", "борт"), ("шла", "идти"), ("дом", "дом"), ("дом", "дом"), (None, "x"), ("", "x"), ("x", ""),
]


def brute(pairs, least, longest):
    votes = defaultdict(Counter)
    for word, lemma in pairs:
        if word and lemma:
            same = max(i for i in range(min(len(word), len(lemma)) + 1) if word[:i] == lemma[:i])
            for n in range(len(word) - same, min(len(word), longest) + 1):
                votes[word[len(word) - n :]][len(word) - same, lemma[same:]] += 1
    return {e: (*min(c, key=lambda x: (-c[x], x)), max(c.values())) for e, c in votes.items() if sum(c.values()) >= least}


def applied(word, rules, longest):
    for n in range(min(longest, len(word)), -1, -1):
        rule = rules.get(word[len(word) - n :])
        if rule and len(word) > rule[0]:
            return word[: len(word) - rule[0]] + rule[1]
    return None


@pytest.mark.parametrize(("least", "longest"), [(1, 6), (2, 4)])
def test_rules(spark, least, longest):
    rnd = random.Random(least)
    pairs = PAIRS + [("".join(rnd.choices("абв", k=rnd.randrange(1, 7))), "".join(rnd.choices("абв", k=rnd.randrange(1, 5)))) for _ in range(80)]
    df = spark.createDataFrame(pairs, "word string, lemma string")
    rules = lemmas.learn(df, least, longest)
    expected = brute(pairs, least, longest)
    assert {r.ending: (r.strip, r.add, r.n) for r in rules.collect()} == expected
    words = ["самолётами", "портами", "долины", "ы", "english", "бабава", "", "12ы", "ж"] + [w for w, _ in pairs if w]
    known = spark.createDataFrame([("шла", "идти"), ("unused", "u")], "word string, lemma string")
    asked = spark.createDataFrame([(w,) for w in words] + [(None,)], "word string")
    got = {r.word: r.lemma for r in lemmas.lemmas(asked.where("word is not null"), rules, known, longest=longest, default=lambda c: F.concat(F.lit("?"), F.col(c))).collect()}
    for w in words:
        russian = any("а" <= c <= "я" or c == "ё" for c in w)
        assert got[w] == ("идти" if w == "шла" else (applied(w, expected, longest) or f"?{w}") if russian else w), w
    column = lemmas.analyzed("word", lemmas.rule_analyzer(rules, longest=longest))
    assert {r.word: r.lemma for r in asked.select("word", column.alias("lemma")).collect()} == {w: applied(w, expected, longest) or w for w in words} | {None: None}


def test_the_stem_is_the_default(spark):
    rules = lemmas.learn(spark.createDataFrame([], "word string, lemma string"))
    words = spark.createDataFrame([("книгой",), ("test",)], "word string")
    assert {r.word: r.lemma for r in lemmas.lemmas(words, rules).collect()} == {"книгой": "книг", "test": "test"}
    assert lemmas.lemmas(words.limit(0), rules).count() == 0


def test_counts_by_lemma(spark):
    rules = lemmas.learn(spark.createDataFrame(PAIRS, "word string, lemma string"), 2)
    freqs = spark.createDataFrame([("самолёты", 3), ("самолётами", 4), ("кабины", 2), ("кабина", 1), ("air", 9)], "term string, cnt long")
    assert {r.lemma: r.cnt for r in lemmas.lemma_freqs(freqs, rules).collect()} == {"самолёт": 7, "кабина": 3, "air": 9}


def test_an_analyzer_is_loaded_once_in_a_task(spark, tmp_path):
    def analyzer():
        (tmp_path / "loaded").open("a").write("x")
        return lambda words: words.str.upper()

    docs = spark.createDataFrame([(i, f"w{i % 5}") for i in range(5000)], "doc_id long, text string")
    words = docs.select(F.col("text").alias("word")).coalesce(1)
    got = words.select(lemmas.analyzed("word", analyzer).alias("x")).distinct().collect()
    assert sorted(r.x for r in got) == [f"W{i}" for i in range(5)] and (tmp_path / "loaded").read_text() == "x"
    assert stats.term_freqs(docs).count() == 5
