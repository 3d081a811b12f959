"""Order MinHash fingerprints, whose likeness follows edit distance.

Each of ``n_slots`` random orders ranks a document's occurrence-numbered k-mers of words. The
``keep`` smallest of an order are put back in text order and hashed as a tuple: one slot. Two
documents agree in a slot if they share these k-mers in the same order.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import saved
from folioscope.llm.words import BASE, Words, mix, runs_of

SLOTS, KEEP, K = 64, 2, 2
#: Texts without words have this fingerprint.
EMPTY = "0" * 16


def occurrence_numbered(h: np.ndarray) -> np.ndarray:
    """Each k-mer's hash mixed with how often the same k-mer stood before it."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    number = np.arange(len(s)) - np.repeat(at, np.diff(np.append(at, len(s))))
    out = np.empty(len(h), np.uint64)
    out[order] = mix(s + number.astype(np.uint64) * np.uint64(BASE))
    return out


def order_minhash(h: np.ndarray, n_slots: int = SLOTS, keep: int = KEEP) -> np.ndarray:
    """The slots of a text's k-mer hashes, in text order; no k-mers give no slots.

    A text with fewer than ``keep`` k-mers keeps all it has.
    """
    if not len(h):
        return np.zeros(0, np.uint32)
    h = occurrence_numbered(h)
    keep = min(keep, len(h))
    seeds = mix(np.arange(1, n_slots + 1, dtype=np.uint64) * np.uint64(BASE))
    chosen = np.empty((n_slots, keep), np.int64)
    step = max(1, min(n_slots, 65_536 // len(h)))
    for first in range(0, n_slots, step):
        # Less than a whole mixer for each order: enough to rank hashes that are already mixed.
        x = (h[None, :] ^ seeds[first : first + step, None]) * np.uint64(BASE)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        for r in range(keep):
            best = x.argmin(axis=1)
            chosen[first : first + step, r] = best
            x[np.arange(len(x)), best] = np.uint64(0xFFFFFFFFFFFFFFFF)
    chosen.sort(axis=1)
    acc = seeds.copy()
    for r in range(keep):
        acc = mix(acc * np.uint64(BASE) + h[chosen[:, r]])
    return acc.astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of slots that agree; texts without words are like each other and like nothing else."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def as_text(slots: np.ndarray) -> str:
    return slots.astype(">u4").tobytes().hex() if len(slots) else EMPTY


def fingerprint(text: str, words: Words) -> np.ndarray:
    """The Order MinHash slots of one text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    rows, starts, ends = words.find(data, np.array([0, len(data)]))
    return order_minhash(runs_of(rows, words.hashes(data, starts, ends), K, 1)[1] if len(starts) else np.zeros(0, np.uint64))


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """``text`` with its last half of code points (rounded down) replaced by as many first ones of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``COLUMNS`` for runs of (range, borrowed, doc_id, text) in order; a range's last row is borrowed.

    Only a row and the one before it are held.
    """
    words = Words()
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in COLUMNS.split(", ")]
    held = None
    for batch in batches:
        rows = []
        for borrowed, doc_id, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            text = text.as_py() or ""
            own = fingerprint(text, words)
            if held is not None:
                last_id, last_text, last = held
                changed = edited(last_text, text)
                after = fingerprint(changed, words)
                sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((last_id, len(last_text), sha, as_text(last), as_text(after), likeness(last, after), likeness(last, own)))
            held = None if borrowed else (doc_id, text, own)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)


def range_number(doc_id: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are at most ``doc_id``, found in two steps of 256 each."""
    step = 256
    ids = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<long>")
    count = lambda x: F.size(F.filter(x, lambda c: c <= doc_id))
    if not cuts:
        return F.lit(0)
    block = F.greatest(count(ids(cuts[::step])) - 1, F.lit(0)) * step
    return block + count(F.slice(ids(cuts), block + 1, step))


def quantile_cuts(docs: DataFrame, n: int, rows_per_range: int, max_ranges: int) -> tuple[list[int], dict[int, int]]:
    """(ascending cuts of doc_id, how many ranges' rows each crowded id has) for ``n`` rows with ids."""
    n_ranges = max(1, min(-(-n // rows_per_range), max_ranges))
    at = [i / n_ranges for i in range(1, n_ranges)]
    found = Counter(int(x) for x in docs.stat.approxQuantile("doc_id", at, 0.2 / n_ranges)) if at else Counter()
    return sorted(found), {x: k + 1 for x, k in found.items() if k > 1}


def with_slices(docs: DataFrame, crowded: dict[int, int], null_slices: int) -> DataFrame:
    """``docs`` with slice: of a crowded id, or of rows without one, the slice of the range of its text's hash, from 1 on; 0 for others."""
    place = F.shiftright("salt", 33).cast("double") / float(2**31) + 0.5  # 0 to 1, in order of salt
    out = F.when(F.col("doc_id").isNull(), 1 + F.floor(place * null_slices))
    if crowded:
        slices = docs.sparkSession.createDataFrame(list(crowded.items()), "crowded long, slices int")
        found = F.broadcast(slices)  # one for two ranges at most
        docs = docs.join(found, F.col("doc_id") == F.col("crowded"), "left")
        out = out.when(F.col("slices").isNotNull(), 1 + F.floor(place * F.col("slices")))
    return docs.withColumn("slice", out.otherwise(0).cast("int")).select("doc_id", "salt", "text", "slice")


def fingerprints(docs: DataFrame, rows_per_range: int = 1_000, max_ranges: int = 65_536) -> DataFrame:
    """``COLUMNS`` for each row of ``docs``: doc_id, text; the next document is the one of next smaller id.

    Rows are dealt to ranges of doc_id by quantiles, and those of an id that fills several ranges, or of none, to slices of
    their text's hash. Each range borrows the first row of the next
    one, and the last range borrows the first row of all, so that only a row a range is moved
    twice. Null and empty texts have no characters and the fingerprint of texts without words.
    Rows of equal id are in order of their text's hash, so repeated rows follow each other; null ids
    come last. A very long text is one row's work. A table of one row is its own next document; an empty table gives
    none. Other columns, whatever their names, are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, n_ids = docs.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    cuts, crowded = quantile_cuts(docs, n_ids, rows_per_range, max_ranges)
    null_slices = max(1, min(-(-(n - n_ids) // rows_per_range), max_ranges))
    # Counted from the largest ids down; null ids have ranges of their own at the end.
    number = F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(-range_number(F.col("doc_id"), cuts))
    own = with_slices(docs.withColumn("salt", F.xxhash64("text")), crowded, null_slices)
    own = own.withColumn("range", F.struct(number.cast("int").alias("r"), "slice")).drop("slice")
    down = Window.orderBy("range")
    heads = own.groupBy("range").agg(F.max("doc_id").alias("top"))
    to = F.coalesce(F.lag("range").over(down), F.max("range").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # One row for each range and slice, of max_ranges three times at most.
    heads = saved(heads.select("top", F.col("range").alias("head"), to.alias("to")), "heads")
    firsts = own.join(F.broadcast(heads), (F.col("range") == F.col("head")) & F.col("doc_id").eqNullSafe(F.col("top")))
    firsts = firsts.groupBy("to").agg(F.max("doc_id").alias("doc_id"), F.min(F.struct("salt", "text")).alias("x"))
    borrowed = firsts.select(F.col("to").alias("range"), F.lit(True).alias("borrowed"), "doc_id", "x.salt", "x.text")
    rows = own.select("range", F.lit(False).alias("borrowed"), "doc_id", "salt", "text").unionByName(borrowed)
    dealt = rows.repartition("range").sortWithinPartitions("range", "borrowed", F.col("doc_id").desc_nulls_last(), "salt", "text")
    return dealt.select(F.col("range.r").alias("range"), "borrowed", "doc_id", "text").mapInArrow(along, COLUMNS)
