"""Text functions as Column expressions: folding, the two tokenizers, titles and sizes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters that are folded, and the letters and digits that make up tokens.
UPPER = "".join(map(chr, [*range(0x41, 0x5B), *range(0x410, 0x430), 0x401]))
LOWER = "".join(map(chr, [*range(0x61, 0x7B), *range(0x430, 0x450), 0x451]))
LETTER = "[0-9A-Za-z\\u0400-\\u052F]"
FREQUENCY_TOKEN = "[A-Za-zА-Яа-яЁё0-9]+(?:-[A-Za-zА-Яа-яЁё0-9]+)*"


@dataclass(frozen=True)
class Tokenizer:
    """Settings of the search tokenizer, and the expressions that follow from them."""

    fold_yo: bool = True
    keep_joiners: bool = True
    max_bytes: int = 256

    @property
    def pattern(self) -> str:
        """A run of letters and digits; a single - or _ between two of them joins."""
        return f"{LETTER}+(?:[-_]{LETTER}+)*" if self.keep_joiners else f"{LETTER}+"

    def fold(self, token: Column) -> Column:
        """Lower case for Latin and Russian letters alone, and е for ё if asked for; no letter's size in bytes changes. Plain ASCII is told by its size."""
        lower = LOWER[:-1] + ("е" if self.fold_yo else "ё")
        letters = F.translate(token, UPPER + ("ё" if self.fold_yo else ""), lower + ("е" if self.fold_yo else ""))
        return F.when(F.octet_length(token) == F.length(token), F.lower(token)).otherwise(letters)

    def tokens(self, text: Column) -> Column:
        """The array of tokens in order; null gives none. Characters beyond ``max_bytes`` are left out one by one."""
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))
        return F.transform(found, lambda t: F.when(F.octet_length(t) > self.max_bytes, self._capped(self.fold(t))).otherwise(self.fold(t)))

    def _capped(self, token: Column) -> Column:
        room = lambda a, c: F.octet_length(a) + F.octet_length(c) <= self.max_bytes
        kept = F.aggregate(F.split(token, ""), F.lit(""), lambda a, c: F.when(room(a, c), F.concat(a, c)).otherwise(a))
        return F.rtrim(kept, F.lit("-_"))


SEARCH = Tokenizer()


def frequency_tokens(text: Column, split_hyphen: bool = True, normalize_yo: bool = True, min_len: int = 1) -> Column:
    """The tokens that word frequencies count: hyphens join or split, underscores always split."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FREQUENCY_TOKEN), F.lit(0))
    found = F.transform(found, lambda t: F.translate(F.lower(t), "ё", "е") if normalize_yo else F.lower(t))
    if split_hyphen:
        found = F.flatten(F.transform(found, lambda t: F.split(t, "-")))
    return F.filter(found, lambda t: F.length(t) >= min_len)


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def is_blank(line: Column) -> Column:
    """Nothing but spaces and tabs, carriage returns aside."""
    return F.btrim(line, F.lit(" \t\r")) == ""


def title_bytes(line: Column, docid: Column) -> Column:
    """A line's title as bytes, 120 at most.

    Leading blanks and then leading = go. After leading =, a later = ends the title; otherwise ==
    does. Fewer than three bytes give doc_ and the docid.
    """
    start = F.ltrim(line, F.lit(" \t"))
    marked = start.startswith("=")
    rest = F.when(marked, F.ltrim(F.regexp_replace(start, "^=+", ""), F.lit(" "))).otherwise(start)
    closed = marked & (F.locate("=", rest) > 1)
    whole = F.when(closed, F.substring_index(rest, "=", 1)).otherwise(F.substring_index(rest, "==", 1))
    cut = F.substring(F.encode(whole, "UTF-8"), 1, 120)
    return F.when(closed | (F.octet_length(cut) >= 3), cut).otherwise(F.encode(F.concat(F.lit("doc_"), docid.cast("string")), "UTF-8"))


def vbyte_length(value: Column) -> Column:
    """Bytes of an unsigned number in groups of seven bits."""
    out = F.lit(5)
    for n in (4, 3, 2, 1):
        out = F.when(value < (1 << 7 * n), F.lit(n)).otherwise(out)
    return out.cast("long")


def human_size(n: Column) -> Column:
    """``n`` bytes with one decimal and the largest fitting unit; null: N/A."""
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    show = lambda i: F.format_string(f"%.1f {units[i]}", n.cast("double") / F.lit(float(1024**i)))
    out = show(len(units) - 1)
    for i in reversed(range(len(units) - 1)):
        out = F.when(n < F.lit(1024 ** (i + 1)), show(i)).otherwise(out)
    return F.when(n.isNull(), F.lit("N/A")).otherwise(out)


def date_of(seconds: Column) -> Column:
    """Seconds since 1970 as date and time in the session's time zone; null stays null."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")
