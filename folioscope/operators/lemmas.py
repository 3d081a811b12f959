"""Dictionary forms of words: rules of endings learned from pairs, and analyzers that are plugged in.

A pair (word, lemma) says how a word's end changes: so many letters go, so many come. Every ending of the word that holds the letters that go
votes for its change; an ending's most frequent change is its rule. A word that no pair names is changed by the rule
of its longest ending, as a walk down a trie of reversed endings would find it. Learning and applying are joins and groupings,
so neither the pairs nor the words have to fit anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.stem import stem_column
from folioscope.storage import saved

#: Words with a letter of the Russian alphabet; others are their own lemma.
RUSSIAN = "[а-яё]"
#: Letters of the longest ending that has a rule.
LONGEST = 6
Analyzer = Callable[[pd.Series], pd.Series]


def changes(pairs: DataFrame) -> DataFrame:
    """(word, strip, add): how many letters of a word's end go to make its lemma of ``pairs`` (word, lemma), and what comes."""
    same = F.expr("aggregate(sequence(0, least(length(word), length(lemma))), 0, (a, i) -> if(left(word, i) = left(lemma, i), i, a))")
    own = pairs.where("word <> '' and lemma <> ''").select("word", "lemma", same.alias("same"))
    return own.select("word", (F.length("word") - F.col("same")).alias("strip"), F.expr("substr(lemma, same + 1)").alias("add"))


def endings(word: Column, first: Column, longest: int) -> Column:
    """The endings of a word from ``first`` letters up to ``longest``, as (ending, size)."""
    sizes = F.when(first <= F.least(F.length(word), F.lit(longest)), F.sequence(first, F.least(F.length(word), F.lit(longest)))).otherwise(F.array().cast("array<int>"))
    return F.transform(sizes, lambda n: F.struct(F.right(word, n).alias("ending"), n.alias("size")))


def learn(pairs: DataFrame, least: int = 2, longest: int = LONGEST) -> DataFrame:
    """(ending, size, strip, add, n): the rule of each ending that ``least`` pairs of ``pairs`` (word, lemma) have, made by n of them.

    Of changes that are equally frequent the one that takes fewest letters counts, then the first by what it adds. Repeated pairs vote as
    often; pairs with a null or empty side do not.
    """
    votes = changes(pairs).select("strip", "add", F.explode(endings(F.col("word"), F.col("strip"), longest)).alias("e"))
    votes = votes.groupBy("e.ending", "e.size", "strip", "add").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("ending", "size").agg(F.sum("n").alias("all"), F.min(F.struct((-F.col("n")).alias("less"), "strip", "add")).alias("b"))
    return best.where(F.col("all") >= least).select("ending", "size", "b.strip", "b.add", (-F.col("b.less")).alias("n"))


def lemmas(words: DataFrame, rules: DataFrame, known: DataFrame | None = None, which: str = RUSSIAN, longest: int = LONGEST, default: Callable[[str], Column] = stem_column) -> DataFrame:
    """(word, lemma) of distinct ``words`` (word).

    The lemma is that of ``known`` (word, lemma, a word once) if it has the word; else what the rule of the longest ending makes of it, if
    that leaves a letter; else ``default``, the stem. Words without a match of ``which`` are their own lemma.
    """
    own = words.select("word").distinct()
    asked = own.where(F.col("word").rlike(which))
    each = asked.select("word", F.explode(endings(F.col("word"), F.lit(0), longest)).alias("e")).select("word", "e.*")
    met = each.join(rules.select("ending", "strip", "add"), "ending").where(F.length("word") > F.col("strip"))
    ruled = met.groupBy("word").agg(F.max(F.struct("size", "strip", "add")).alias("r"))
    ruled = ruled.select("word", F.expr("concat(left(word, length(word) - r.strip), r.add)").alias("by_rule"))
    out = own.join(ruled, "word", "left")
    if known is not None:
        out = out.join(known.select("word", F.col("lemma").alias("by_known")), "word", "left")
    own_form = F.when(~F.col("word").rlike(which), F.col("word"))
    chosen = [own_form, *([F.col("by_known")] if known is not None else []), F.col("by_rule")]
    out = out.select("word", F.coalesce(*chosen).alias("lemma"))
    return out.select("word", F.coalesce("lemma", default("word")).alias("lemma"))


def lemma_freqs(freqs: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """(lemma, cnt) of word counts (term, cnt): ``lemmas`` of distinct words, and their sums."""
    freqs = saved(freqs.select(F.col("term").alias("word"), "cnt"), "freqs")
    return freqs.join(lemmas(freqs, rules, **options), "word").groupBy("lemma").agg(F.sum("cnt").alias("cnt"))


def analyzed(word: Column | str, analyzer: Callable[[], Analyzer]) -> Column:
    """What a plugged-in analyzer makes of words: ``analyzer`` is called once in a task, to load what it needs, and makes a function of Series.

    To be used on distinct words; ``stats.mapped_freqs`` and ``lemmas`` (as ``default``) take the column.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = analyzer()
        for batch in batches:
            yield own(batch)

    return run(word)


def rule_analyzer(rules: DataFrame, most: int = 200_000, longest: int = LONGEST) -> Callable[[], Analyzer]:
    """The rules as an analyzer, for columns of words that are not distinct: at most ``most`` of them, those of most votes, go to tasks."""
    rows = rules.orderBy(F.desc("n"), "ending").limit(most).collect()
    table = {r["ending"]: (r["strip"], r["add"]) for r in rows}

    def lemma(word: str | None) -> str | None:
        for size in range(min(longest, len(word or "")), -1, -1):
            rule = table.get(word[len(word) - size :]) if word else None
            if rule and len(word) > rule[0]:
                return word[: len(word) - rule[0]] + rule[1]
        return word

    return lambda: lambda words: words.map(lemma, na_action="ignore")
