"""Repeated passages of words, by super-k-mers: runs of windows that share a minimiser.

A window of ``k`` words chooses the run of ``m`` words of smallest hash in it, the leftmost of equals:
its minimiser. Consecutive windows that chose the same one are a super-k-mer and travel together, as one
packed string, to the minimiser's bucket; equal windows choose equal minimisers, so they meet there,
and sorting a bucket's windows word by word finds each one's first occurrence.

Ahead of the strings go their hashes alone: super-k-mers whose minimiser stands nowhere else, and those that
equal an earlier one as a whole, need no string. Of equal ones a task sends the first only. Minimisers of
very many different super-k-mers would make full buckets: their windows travel one by one, as digests
that are aggregated before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import saved, small
from folioscope.llm.repeats import merged, numbered, sliding_min
from folioscope.llm.tokens import WHITE, Splitter
from folioscope.llm.words import BASE, MIX, mix, powers

#: Words of a minimiser.
M = 6
#: Minimisers with more different super-k-mers than this have their windows sent one by one.
HOT = 256
#: Words of a document whose windows are looked at together.
SPAN = 1 << 20
#: Super-k-mers of one minimiser that one task may gather; more are dealt out by content.
CROWD = 50_000

RUNS = "bucket long, content long, doc_id long, version long, start int, windows int"
SPANS = "doc_id long, version long, start int, end int"


def batch_of(schema: str, columns: list, mask: np.ndarray | None = None) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kinds[t]) for x, (_, t) in zip(columns, fields)], [n for n, _ in fields])


class SuperKmers:
    """Cuts rows of word hashes into super-k-mers; keeps the table of powers between calls."""

    def __init__(self, k: int, m: int):
        self.k, self.m = k, m
        self.up, self.down = powers(1 << 12)

    def cut(self, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first word, windows, bucket, content) of each super-k-mer; ``row`` tells which words are of one text."""
        k, n = self.k, len(h)
        if n < k:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
        grams = h[: n - self.m + 1].copy()
        for j in range(1, self.m):
            grams = mix(grams * np.uint64(BASE) + h[j : n - self.m + 1 + j])
        low = np.uint64((1 << 28) - 1)
        chosen = (sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), k - self.m + 1) & low).astype(np.int64)
        good = row[: n - k + 1] == row[k - 1 :]
        new = good.copy()
        new[1:] &= ~good[:-1] | (chosen[1:] != chosen[:-1]) | (row[1 : n - k + 1] != row[: n - k])
        first = np.flatnonzero(new)
        windows = np.bincount(np.cumsum(new)[good] - 1, minlength=len(first))
        if n >= len(self.up):
            self.up, self.down = powers(2 * n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * self.up[:n], out=sums[1:])
        end = first + windows + k - 1
        content = mix((sums[end] - sums[first]) * self.down[first] + (end - first).astype(np.uint64) * np.uint64(MIX[1]))
        return first, windows, grams[chosen[first]], content


def find_runs(k: int, m: int):
    """For mapInArrow on (doc_id, version, text): rows of ``RUNS``, by the numbers of their words.

    Of equal super-k-mers of a batch only the first in order of (doc_id, version, start) goes out; the words of
    the others are known to repeat and go out as spans, with a null content and their length as ``windows``.
    """

    def rows_of(column: pa.Array, splitter: Splitter) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(row, hash, number of the first word) of runs of words; a very long text comes in runs that share k - 1 words."""
        held: list[np.ndarray] = []
        for words in splitter.runs(column):
            if words.goes_on or held:
                held.append(words.hash)
            if held and not words.goes_on:
                h, held = np.concatenate(held), []
                for base in range(0, max(1, len(h) - k + 1), SPAN):
                    part = h[base : base + SPAN + k - 1]
                    yield np.full(len(part), words.first), part, base
            elif not words.goes_on:
                yield words.row, words.hash, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, cutter = Splitter(WHITE, lower=False), SuperKmers(k, m)
        for batch in batches:
            number, ids, versions = numbered(*(batch.column(c).to_numpy(zero_copy_only=False) for c in range(2)))
            found = []
            for row, h, base in rows_of(batch.column(2), splitter):
                first, windows, bucket, content = cutter.cut(row, h)
                own = row[first]
                found.append((number[own], first - np.searchsorted(row, own) + base, windows, bucket, content))
            if not found:
                continue
            doc, start, windows, bucket, content = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((start, doc, bucket, content))
            new = np.ones(len(order), bool)
            new[1:] = (content[order][1:] != content[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
            if not len(order):
                continue
            first = order[new]
            its_first = first[np.cumsum(new) - 1]
            again = order[(doc[order] != doc[its_first]) | (start[order] != start[its_first])]
            d, s, e = merged(doc[again], start[again], start[again] + windows[again] + k - 1)
            anywhere = mix(ids[d].view(np.uint64) ^ s.astype(np.uint64))
            yield batch_of(
                RUNS,
                [
                    np.concatenate([bucket[first], anywhere]).view(np.int64),
                    pa.array(np.concatenate([content[first].view(np.int64), np.zeros(len(d), np.int64)]), mask=np.arange(len(first) + len(d)) >= len(first)),
                    *(x[np.concatenate([doc[first], d])] for x in (ids, versions)),
                    np.concatenate([start[first], s]).astype(np.int32),
                    np.concatenate([windows[first], e - s]).astype(np.int32),
                ],
            )

    return run


PACKED = "bucket long, digest binary, doc_id long, version long, start int, packed binary, end int"


def pack(k: int):
    """For mapInArrow on (doc_id, version, text, found: array of (start, windows, bucket, hot)): rows of ``PACKED``.

    A super-k-mer is one string of its words, joined by a space. Windows of hot minimisers go out as digests of 16 bytes; of
    equal ones of a batch only the first, the others as spans, with their end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            firsts: dict[bytes, tuple[int, int, int]] = {}
            again: list[tuple[int, int, int]] = []
            texts = batch.column(2).cast(pa.binary())
            for i, (doc_id, version, found) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)))):
                words = texts[i].as_py().split()
                for x in found:
                    start, windows = x["start"], x["windows"]
                    if not x["hot"]:
                        rows.append((x["bucket"], None, doc_id, version, start, b" ".join(words[start : start + windows + k - 1]), None))
                        continue
                    for at in range(start, start + windows):
                        own = (doc_id, version, at)
                        digest = hashlib.blake2b(b" ".join(words[at : at + k]), digest_size=16).digest()
                        other = firsts.setdefault(digest, own)
                        if other != own:
                            again.append(max(own, other))
                            firsts[digest] = min(own, other)
            doc, version, start = np.array(again, np.int64).reshape(-1, 3).T
            doc, ids, versions = numbered(doc, version)
            d, s, e = merged(doc, start, start + k)
            rows += [(None, digest, *own, None, None) for digest, own in firsts.items()]
            rows += [(None, None, *span[:3], None, span[3]) for span in zip(ids[d].tolist(), versions[d].tolist(), s.tolist(), e.tolist())]
            if rows:
                yield batch_of(PACKED, list(zip(*rows)))

    return run


def window_ranks(ids: np.ndarray, k: int) -> np.ndarray:
    """A number for each run of ``k`` ids, equal for equal runs alone: ranks of runs of doubling length."""
    ranks, have = ids.astype(np.int64), 1
    while have < k:
        step = min(have, k - have)
        n = len(ranks) - step
        pairs = ranks[:n] * (int(ranks.max(initial=0)) + 1) + ranks[step:]
        ranks, have = np.unique(pairs, return_inverse=True)[1].astype(np.int64), have + step
    return ranks


def later_windows(k: int, chunk: int = 1 << 20):
    """For mapInArrow on (bucket, doc_id, version, start, packed) in order of bucket: spans of windows that are not their first.

    Whole buckets are taken together, up to ``chunk`` bytes; their words are numbered and their windows sorted.
    """

    def spans(docs: list, versions: list, starts: list, packed: list) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        lists = [raw.split() for raw in packed]
        ids = np.array([numbers.setdefault(w, len(numbers)) for own in lists for w in own], np.int64)
        count = np.array([len(own) for own in lists])
        base = np.cumsum(count) - count
        windows = count - k + 1
        run = np.repeat(np.arange(len(lists)), windows)
        place = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
        rank = window_ranks(ids, k)[base[run] + place]
        doc, own, kinds = numbered(np.array(docs, np.int64), np.array(versions, np.int64))
        doc, start = doc[run], np.array(starts, np.int64)[run] + place
        order = np.lexsort((start, doc, rank))
        new = np.ones(len(order), bool)
        new[1:] = rank[order][1:] != rank[order][:-1]
        first = order[new][np.cumsum(new) - 1]
        later = order[(doc[order] != doc[first]) | (start[order] != start[first])]
        d, s, e = merged(doc[later], start[later], start[later] + k)
        return batch_of(SPANS, [own[d], kinds[d], s.astype(np.int32), e.astype(np.int32)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for bucket, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size >= chunk and bucket != last:
                    yield spans(*zip(*held))
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                last = bucket
        if held:
            yield spans(*zip(*held))

    return run


def crowds(docs: DataFrame, k: int, m: int, crowd: int, share: float) -> DataFrame | None:
    """(bucket): minimisers with about ``crowd`` super-k-mers or more that no task has settled, or None.

    They are told from a sample of ``share`` of the documents. That decides only how rows are dealt out, never what is found.
    """
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000)
    seen = sample.mapInArrow(find_runs(k, m), RUNS).where("content is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    crowded = saved(seen.where(F.col("n") >= crowd * share).select(F.col("bucket").alias("_bucket")), "crowded")
    return None if crowded.isEmpty() else crowded


def repeated_windows(docs: DataFrame, k: int = 20, m: int = M, broadcast_rows: int = 1_000_000, crowd: int = CROWD, share: float = 0.01) -> DataFrame:
    """``SPANS`` of ``docs`` (doc_id, version, text): words covered by ``k`` words that also start earlier, spans may overlap."""
    key = ["doc_id", "version"]
    docs = docs.where("doc_id is not null and text is not null")
    rows = docs.mapInArrow(find_runs(k, m), RUNS)
    crowded = crowds(docs, k, m, crowd, share)
    rows = rows.withColumn("salt", F.lit(0).cast("long"))
    if crowded is not None:
        rows = rows.join(small(crowded, broadcast_rows), F.col("bucket") == F.col("_bucket"), "left")
        rows = rows.withColumn("salt", F.when(F.col("_bucket").isNotNull(), F.coalesce("content", F.lit(0))).otherwise(0)).drop("_bucket")
    # A rank, as rows that repeat an id and a text are at the same place: none is later than the other.
    same, bucket = Window.partitionBy("bucket", "salt", "content").orderBy(*key, "start"), Window.partitionBy("bucket", "salt")
    met = rows.withColumn("nth", F.rank().over(same))
    crowd_ = F.col("salt") != 0
    met = met.withColumn("several", crowd_ | (F.min("content").over(bucket) != F.max("content").over(bucket)))
    met = met.withColumn("hot", crowd_ | (F.count(F.when(F.col("nth") == 1, 1)).over(bucket) > HOT)).drop("salt")
    met = saved(met.where("content is null or nth > 1 or several"), "minimisers")
    known = met.where("content is null").select(*key, "start", (F.col("start") + F.col("windows")).alias("end"))
    again = met.where("content is not null and nth > 1").select(*key, "start", (F.col("start") + F.col("windows") + (k - 1)).alias("end"))
    met = met.where("content is not null and nth = 1 and several")
    found = saved(met.groupBy(*key).agg(F.collect_set(F.struct("start", "windows", "bucket", "hot")).alias("found")), "found")
    own = docs.join(small(found.select(*key), broadcast_rows), key, "left_semi").join(found, key)
    packed = saved(own.select(*key, "text", "found").mapInArrow(pack(k), PACKED), "packed")
    told = packed.where("end is not null").select(*key, "start", "end")
    each = packed.where("digest is not null").select("digest", F.struct(*key, "start").alias("at"))
    first = each.groupBy("digest").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first != last").drop("last")
    hot = each.join(first, "digest").where("at != first").select("at.*", (F.col("at.start") + k).alias("end"))
    strings = packed.where("packed is not null").select("bucket", *key, "start", "packed")
    sorted_ = strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(later_windows(k), SPANS)
    return known.unionByName(again).unionByName(told).unionByName(hot).unionByName(sorted_)


KEPT = "doc_id long, n_words long, n_removed long, kept binary"


def keep(texts: bool):
    """For mapInArrow on (doc_id, text, starts, ends): ``KEPT`` of each document, its kept words or, unless ``texts``, their SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            raw = batch.column(1).cast(pa.binary())
            for i, (doc_id, starts, ends) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)))):
                words = (raw[i].as_py() or b"").split()
                n = len(words)
                if starts:
                    own = np.array(starts, np.int64)
                    _, first, last = merged(np.zeros(len(own), np.int64), own, np.array(ends, np.int64))
                    words = [w for a, b in zip([0, *last.tolist()], [*first.tolist(), n]) for w in words[a:b]]
                text = b" ".join(words)
                rows.append((doc_id, n, n - len(words), text if texts else hashlib.sha256(text).digest()))
            if rows:
                yield batch_of(KEPT, list(zip(*rows)))

    return run


def passage_dedup(docs: DataFrame, k: int = 20, texts: bool = True, broadcast_rows: int = 1_000_000, **dealing) -> DataFrame:
    """``KEPT`` for each row of ``docs`` (doc_id, text): without the words of every window of ``k`` words that also starts earlier.

    Earlier is a smaller doc_id, or a smaller start in the same document. ``kept`` is the kept words joined by a space as UTF-8, or
    their SHA-256 where ``texts`` is false. Words are as they stand between white space. Null, empty and short texts lose nothing,
    an empty table gives no rows. A row without a doc_id has no place in the order: it loses nothing and takes nothing from
    others. Rows that repeat id and text are one document, returned as often; different texts of one id are documents
    in order of their 64-bit hash. A very long text is split in parts that share k - 1 words. Other columns are not read.

    Whole super-k-mers are told apart by two 64-bit hashes, of their minimiser and of all their words; windows by their
    words, but for those of hot minimisers, told by 128 bits.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    key = ["doc_id", "version"]
    spans = repeated_windows(docs, k, broadcast_rows=broadcast_rows, **dealing)
    spans = saved(spans.groupBy(*key).agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")), "spans")
    ids = small(spans.select(*key), broadcast_rows)
    none = F.lit(None).cast("array<int>")
    hit = docs.join(ids, key, "left_semi").join(spans, key).select("doc_id", "text", "starts", "ends")
    free = docs.join(ids, key, "left_anti").select("doc_id", "text", none.alias("starts"), none.alias("ends"))
    return hit.mapInArrow(keep(texts), KEPT).unionByName(free.mapInArrow(keep(texts), KEPT))


def kept_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document."""
    return passage_dedup(docs, texts=False).select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"))


#: The query over documents in DuckDB, by every window of 20 words.
DOCUMENTS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS x FROM documents),
w AS (SELECT doc_id, s, array_to_string(x[s:s + 19], ' ') AS g FROM (SELECT doc_id, x, unnest(range(1, greatest(len(x) - 18, 1))) AS s FROM d)),
r AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1),
c AS (SELECT DISTINCT doc_id, s + unnest(range(20)) AS i FROM r),
k AS (SELECT d.doc_id, list(w ORDER BY u.i) FILTER (c.i IS NULL) AS kept, count(c.i) AS gone
      FROM (SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM d) u JOIN d USING (doc_id)
      LEFT JOIN c ON c.doc_id = u.doc_id AND c.i = u.i GROUP BY d.doc_id)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
