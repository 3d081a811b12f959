"""The Russian stemmer, as a vectorised function for distinct words."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Vowels, and the endings in the order in which they are tried.
VOWELS = "аеиоуыэюя"
GERUND_FREE = "ившись ывшись ивши ывши ив ыв".split()
GERUND_AFTER_A = "вшись вши в".split()
ADJECTIVE = "его ого ему ому ими ыми ее ие ые ое ей ий ый ой ем им ым ом их ых ую юю ая яя ою ею".split()
PARTICIPLE_FREE = "ующ ивш ывш".split()
PARTICIPLE_AFTER_A = "ем нн вш ющ щ".split()
VERB_AFTER_A = "нно ешь ете йте ют ла на ли ло но ет ем ны ть й л н".split()
VERB_FREE = "ейте уйте ена ила ыла ите или ыли ило ыло ено ует ены ить ыть ишь ей уй ен ил ыл им ым ят ют ит ыт ую ю".split()
NOUN = "иями иях ией ями ами иям ием ях ах ев ов ье ие еи ии ей ой ий ем ом ям ам ию ью ия ья а я о е ы и у ю ь й".split()


def after_vowel_and_consonants(word: str, start: int) -> int:
    """The place after the next vowels and all consonants that follow them."""
    i, n = start, len(word)
    while i < n and word[i] not in VOWELS:
        i += 1
    while i < n and word[i] in VOWELS:
        i += 1
    while i < n and word[i] not in VOWELS:
        i += 1
    return i


def cut(word: str, endings: list[str], region: int, after_a: bool = False) -> str | None:
    """``word`` without the first of ``endings`` that fits inside the region, after а or я if asked for; else None."""
    for e in endings:
        at = len(word) - len(e)
        if at >= region and word.endswith(e) and (not after_a or at > 0 and word[at - 1] in "ая"):
            return word[:at]
    return None


def stem(word: str | None) -> str | None:
    """The stem of one word; null stays null. Latin letters keep their case."""
    if word is None or word.isascii():  # no Russian letters
        return word
    folded = "".join(c.lower() if "А" <= c <= "Я" or c == "Ё" else c for c in word).replace("ё", "е")
    region = next((i + 1 for i, c in enumerate(folded) if c in VOWELS), len(folded))
    if region >= len(folded):
        return folded
    second = after_vowel_and_consonants(folded, after_vowel_and_consonants(folded, 0))
    tries = lambda w, *sets: next((x for s, a in sets if (x := cut(w, s, region, a)) is not None), None)
    w = tries(folded, (GERUND_FREE, False), (GERUND_AFTER_A, True))
    if w is None:
        w = folded
        for reflexive in ("ся", "сь"):
            w = cut(w, [reflexive], region) or w
        if (adjective := cut(w, ADJECTIVE, region)) is not None:
            w = adjective
            w = tries(w, (PARTICIPLE_FREE, False), (PARTICIPLE_AFTER_A, True)) or w
        else:
            shorter = tries(w, (VERB_AFTER_A, True), (VERB_FREE, False), (NOUN, False))
            w = w if shorter is None else shorter
    w = cut(w, ["и"], region) or w
    w = cut(w, ["ость", "ост"], second) or w
    soft = cut(w, ["ь"], region)
    if soft is not None:
        w = soft
    else:
        w = cut(w, ["ейше", "ейш"], region) or w
        if w.endswith("нн") and len(w) - 2 >= region:
            w = w[:-1]
    return w if len(w) >= 3 else folded


@F.pandas_udf(StringType())
def stem_column(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``stem`` over Arrow batches. Apply it to distinct words."""
    for batch in words:
        yield batch.map(stem, na_action="ignore")
