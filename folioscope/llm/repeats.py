"""Repeated passages by suffix arrays and their common-prefix interval trees.

Equal strings of ``min_bytes`` bytes choose equal anchors: the 32-byte gram of smallest hash in
each window, the leftmost of equals. All windows that chose one anchor are one segment, so equal
windows meet under their anchor's hash, wherever they stand, and only segments whose anchor
stands elsewhere too are moved. Segments of a few thousand anchors at a time get an enhanced
suffix array; a stack scan over its common-prefix lengths gives the interval tree, and intervals
whose occurrences differ on the left are the maximal repeats, with all occurrences.

Before anything is shuffled, segments that equal an earlier one of the same batch become spans
right away, so a passage on a third of all documents is a few rows of each batch. Keys that many
different segments share all the same are taken apart down to single windows, each settled by a
partially aggregated minimum, so only keys of bounded size reach a suffix array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import saved, small
from folioscope.llm.words import BASE, Words, mix, pieces

GRAM = 32
#: Anchors with more distinct segments than this are split by what their windows share.
HOT = 256
BLOCK = 16
#: Blocks of hot anchors with more rows than this under one key are taken apart into windows.
FULL = 1024
#: Bytes of text that are hashed at a time.
LONG = 1 << 20


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the 32 bytes from each position on, by doubling."""
    h = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))[data]
    factor, width = BASE, 1
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % (1 << 64), width * 2
    return mix(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of ``width`` values from each position on, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def segments(data: np.ndarray, at: np.ndarray, min_bytes: int) -> tuple[np.ndarray, ...]:
    """(row, start, windows, lead, anchor hash) of each segment; start counts from the piece's first byte.

    ``windows`` windows begin at start and the positions after it; the anchor is ``lead`` bytes on.
    """
    none = np.zeros(0, np.int64)
    if len(data) < min_bytes or (at[1:] - at[:-1]).max(initial=0) < min_bytes:
        return none, none, none, none, none.view(np.uint64)
    grams = gram_hashes(data)
    low = np.uint64((1 << 28) - 1)
    chosen = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), min_bytes - GRAM + 1) & low
    lengths = at[1:] - at[:-1]
    row = np.repeat(np.arange(len(lengths)), lengths)[: len(chosen)]
    good = np.arange(len(chosen)) + min_bytes <= at[1:][row]
    new = good.copy()
    new[1:] &= ~good[:-1] | (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    run = np.cumsum(new)[good] - 1
    windows = np.bincount(run, minlength=len(start))
    anchor = chosen[start].astype(np.int64)
    return row[start], start, windows, anchor - start, grams[anchor]


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans, as maximal runs of each document; touching spans are one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # A running maximum that begins anew with each document: shift documents apart.
    number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    far = number * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + far)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] + far[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], (reach - far)[last]


def numbered(doc: np.ndarray, version: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each row, doc and version of each number): documents numbered in order of doc and version."""
    order = np.lexsort((version, doc))
    d, v = doc[order], version[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    number = np.empty(len(d), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, d[new], v[new]


SEGMENTS = "anchor long, content long, doc_id long, version long, start int, shape int"


def find_segments(min_bytes: int):
    """For mapInArrow on (doc_id, version, text): rows of ``SEGMENTS``.

    ``shape`` is 256 * windows + lead. Of equal segments of a batch only the first in order of
    (doc_id, version, start) goes out; the windows of the others are known to repeat and go out as spans,
    with a null content and their length in bytes as shape.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            number, ids, versions = numbered(*(batch.column(c).to_numpy(zero_copy_only=False) for c in range(2)))
            parts = []
            for i, j, piece, offsets in pieces(batch.column(2), LONG):
                for base in range(0, max(1, len(piece) if j == i + 1 else 1), LONG):
                    # A text longer than a piece goes in parts that share all but one byte of a window.
                    data, at = (piece, offsets) if j > i + 1 else (part := piece[base : base + LONG + min_bytes - 1], np.array([0, len(part)]))
                    row, start, windows, lead, anchor = segments(data, at, min_bytes)
                    if len(row):
                        content = words.hashes(data, start, start + windows + min_bytes - 1)
                        parts.append((number[i:j][row], start - at[row] + base, windows, lead, anchor, content))
            if not parts:
                continue
            doc, start, windows, lead, anchor, content = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((start, doc, content))
            new = np.ones(len(order), bool)
            new[1:] = content[order][1:] != content[order][:-1]
            first = order[new]
            its_first = first[np.cumsum(new) - 1]
            again = order[(doc[order] != doc[its_first]) | (start[order] != start[its_first])]
            d, s, e = merged(doc[again], start[again], start[again] + windows[again] + min_bytes - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([anchor[first].view(np.int64), mix(ids[d].view(np.uint64) ^ s.astype(np.uint64)).view(np.int64)])),
                    pa.array(np.concatenate([content[first].view(np.int64), np.zeros(len(d), np.int64)]), mask=np.arange(len(first) + len(d)) >= len(first)),
                    *(pa.array(x[np.concatenate([doc[first], d])]) for x in (ids, versions)),
                    pa.array(np.concatenate([start[first], s]).astype(np.int32)),
                    pa.array(np.concatenate([windows[first] * 256 + lead[first], e - s]).astype(np.int32)),
                ],
                ["anchor", "content", "doc_id", "version", "start", "shape"],
            )

    return run


def cut_segments(min_bytes: int):
    """For mapInArrow on (doc_id, version, text, found: array of (start, shape, anchor, hot)): the bytes of each segment.

    Segments of hot anchors are split into blocks of 16 windows by their distance from the
    anchor; equal windows are in equal blocks and share the block's core, which goes into the key.
    Of equal blocks of a batch only the first goes out with its bytes; the others are known to
    repeat and go out as spans: without bytes, with their end.
    """

    def blocks(raw: bytes, x: dict) -> Iterator[tuple[int, int, int]]:
        """(key, start, end) of the blocks of one segment."""
        start, windows, lead = x["start"], x["shape"] >> 8, x["shape"] & 255
        anchor = start + lead
        for block in range((lead - windows + 1) // BLOCK, lead // BLOCK + 1):
            near = anchor - block * BLOCK
            core = raw[near : near - BLOCK + 1 + min_bytes]
            digest = hashlib.blake2b(core, digest_size=8, salt=b"%d" % block).digest()
            yield int.from_bytes(digest, "little", signed=True), max(start, near - BLOCK + 1), min(start + windows - 1, near) + min_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            firsts: dict[tuple[int, bytes], tuple[int, int, int, int]] = {}
            for doc_id, version, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                for x in found:
                    start = x["start"]
                    if not x["hot"]:
                        rows.append((x["anchor"], doc_id, version, start, raw[start : start + (x["shape"] >> 8) + min_bytes - 1], None))
                        continue
                    for key, first, end in blocks(raw, x):
                        own = (doc_id, version, first, end)
                        other = firsts.setdefault((key, raw[first:end]), own)
                        if other[:3] != own[:3]:
                            later = max(own, other)
                            firsts[key, raw[first:end]] = min(own, other)
                            rows.append((hash(later), *later[:3], None, later[3]))
            rows += [(key, *own[:3], raw, None) for (key, raw), own in firsts.items()]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["key", "doc_id", "version", "start", "bytes", "end"])

    return run


class SuffixArray:
    """The enhanced suffix array of segments laid end to end: order, and common-prefix lengths of neighbours.

    A suffix ends with its segment, and an end comes before every byte. Ranks double in width from
    7 symbols until they span the longest segment; a common prefix is summed up from the widest
    equal ranks downwards. Only suffixes of ``least`` bytes or more are kept.
    """

    def __init__(self, text: np.ndarray, ends: np.ndarray, least: int):
        n = len(text)
        room = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(n)
        symbols = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
        packed, width = np.zeros(n, np.uint64), 7
        for b in range(width):
            packed = (packed << np.uint64(9)) | np.where(room > b, symbols[b : b + n], np.uint64(0))
        ranks = [np.unique(packed, return_inverse=True)[1].astype(np.int64)]
        longest = int(room.max(initial=0))
        while width < longest:
            r = ranks[-1]
            after = np.zeros(n, np.int64)
            going = np.flatnonzero(room > width)
            after[going] = r[going + width] + 1
            ranks.append(np.unique(r * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
            width *= 2
        own = np.flatnonzero(room >= least)
        self.order = own[np.argsort(ranks[-1][own], kind="stable")]
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        lcp, most = np.zeros(len(a), np.int64), np.minimum(room[a], room[b])
        for r in reversed(ranks):
            same = lcp < most
            same[same] = r[a[same]] == r[b[same]]
            a, b, lcp = a + same * width, b + same * width, lcp + same * width
            width //= 2
        for _ in range(6):
            same = lcp < most
            same[same] = text[a[same]] == text[b[same]]
            a, b, lcp = a + same, b + same, lcp + same
        self.lcp = np.minimum(lcp, most)


def maximal_repeats(text: np.ndarray, ends: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, positions) of each maximal repeat of ``least`` bytes or more among the segments.

    The stack scan closes an interval when the common prefix falls below its own; an interval of
    common prefix l is a repeat of l bytes by all suffixes in it. It is maximal if the bytes before
    its occurrences differ, a segment's begin differing from every byte. An interval's left byte is
    kept as it grows: one value while all agree, -1 once they differ.
    """
    found = SuffixArray(text, ends, least)
    order, lcp = found.order, found.lcp
    left = np.concatenate([[-1], text[:-1].astype(np.int64)])
    left[np.concatenate([[0], ends[:-1]])[ends > np.concatenate([[0], ends[:-1]])]] = -1
    left = left[order]
    # Only runs of suffixes with long common prefixes can hold repeats.
    long = lcp >= least
    edge = np.diff(np.concatenate([[0], long.astype(np.int8), [0]]))
    for first, last in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        stack: list[list[int]] = []  # of [common prefix, first suffix, left byte]
        heights, lefts = lcp[first:last].tolist() + [0], left[first : last + 1].tolist()
        for i, height in enumerate(heights):
            begin, byte = i, lefts[i]
            while stack and stack[-1][0] > height:
                length, begin, inside = stack.pop()
                byte = inside if inside == byte else -1
                if byte == -1:
                    yield length, order[first + begin : first + i + 1]
            if height >= least and stack and stack[-1][0] == height:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == byte else -1
            elif height >= least:
                stack.append([height, begin, byte])


REPEATS = "doc_id long, version long, start int, end int"


def later_occurrences(min_bytes: int, chunk: int = 1 << 20):
    """For mapInArrow on (key, doc_id, version, start, bytes) in order of key: spans of repeats that are not their first.

    Whole keys are taken together up to ``chunk`` bytes; every window that equals another is
    under the same key.
    """

    def spans(docs: list, versions: list, starts: list, texts: list) -> pa.RecordBatch:
        text = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(x) for x in texts])
        ends = np.cumsum(lengths)
        doc, ids, own = numbered(np.array(docs), np.array(versions))
        base = np.array(starts)
        segment = np.repeat(np.arange(len(texts)), lengths)
        where = np.arange(len(text)) - np.repeat(ends - lengths, lengths) + base[segment]
        out = [(np.zeros(0, np.int64),) * 3]
        for length, positions in maximal_repeats(text, ends, min_bytes):
            d, s = doc[segment[positions]], where[positions]
            first = np.lexsort((s, d))[0]
            later = (d != d[first]) | (s != s[first])
            out.append((d[later], s[later], s[later] + length))
        d, s, e = merged(*(np.concatenate(x) for x in zip(*out)))
        return pa.RecordBatch.from_arrays([pa.array(ids[d]), pa.array(own[d]), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["doc_id", "version", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, versions, starts, texts, size, last = [], [], [], [], 0, None
        for batch in batches:
            for key, doc_id, version, start, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size >= chunk and key != last:
                    yield spans(docs, versions, starts, texts)
                    docs, versions, starts, texts, size = [], [], [], [], 0
                docs.append(doc_id)
                versions.append(version)
                starts.append(start)
                texts.append(raw)
                size += len(raw)
                last = key
        if texts:
            yield spans(docs, versions, starts, texts)

    return run


WINDOWS = "window binary, doc_id long, version long, start int, end int"


def cut_windows(min_bytes: int):
    """For mapInArrow on (doc_id, version, start, bytes): a row of ``WINDOWS`` for each window, by the hash of its bytes.

    Of equal windows of a batch only the first goes out under its hash; the others are known to
    repeat and go out as spans: without a hash, with their end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts: dict[bytes, tuple[int, int, int]] = {}
            again: list[tuple[int, int, int]] = []
            for doc_id, version, start, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for i in range(len(raw) - min_bytes + 1):
                    own = (doc_id, version, start + i)
                    window = hashlib.blake2b(raw[i : i + min_bytes], digest_size=16).digest()
                    other = firsts.setdefault(window, own)
                    if other != own:
                        again.append(max(own, other))
                        firsts[window] = min(own, other)
            doc, version, first = np.array(again, np.int64).reshape(-1, 3).T
            doc, ids, versions = numbered(doc, version)
            d, s, e = merged(doc, first, first + min_bytes)
            rows = [(window, *own, None) for window, own in firsts.items()]
            rows += [(None, *span) for span in zip(ids[d].tolist(), versions[d].tolist(), s.tolist(), e.tolist())]
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["window", "doc_id", "version", "start", "end"])

    return run


def later_windows(hot: DataFrame, min_bytes: int) -> DataFrame:
    """``REPEATS`` of the rows (doc_id, version, start, bytes) of ``hot``, window by window.

    All occurrences of a window have one key, so all are in ``hot`` or were settled before. The
    minimum is aggregated before the shuffle, and the join is one that Spark can split.
    """
    rows = saved(hot.mapInArrow(cut_windows(min_bytes), WINDOWS), "windows")
    known = rows.where("end is not null").select("doc_id", "version", "start", "end")
    each = rows.where("end is null").select("window", F.struct("doc_id", "version", "start").alias("at"))
    first = each.groupBy("window").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first != last").drop("last")
    later = each.join(first, "window").where("at != first")
    return known.unionByName(later.select("at.doc_id", "at.version", "at.start", (F.col("at.start") + min_bytes).alias("end")))


def crowded_anchors(docs: DataFrame, min_bytes: int, share: float, least: int) -> DataFrame | None:
    """(anchor): anchors of so many different segments that one task should not gather them, or None.

    They are told from a sample of ``share`` of the documents, which decides only how rows are dealt out and
    never what is found: in the sample, such an anchor has ``least`` segments or more, however many documents there are. So an anchor that
    stays whole has some ``least`` / ``share`` segments at most, at any size of the table.
    """
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000).where("text is not null")
    seen = sample.mapInArrow(find_segments(min_bytes), SEGMENTS).where("content is not null").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    crowded = saved(seen.where(F.col("n") >= least).select(F.col("anchor").alias("_anchor")), "crowded")
    return None if crowded.isEmpty() else crowded


def dealt_out(rows: DataFrame, crowded: DataFrame | None, broadcast_ids: int) -> DataFrame:
    """``rows`` with salt: rows meet by anchor and salt. Segments of a crowded anchor meet by their content alone, and go on as a hot anchor's."""
    if crowded is None:
        return rows.withColumn("salt", F.lit(0).cast("long"))
    rows = rows.join(small(crowded, broadcast_ids), F.col("anchor") == F.col("_anchor"), "left")
    return rows.withColumn("salt", F.when(F.col("_anchor").isNotNull(), F.coalesce("content", F.lit(0))).otherwise(0)).drop("_anchor")


def repeated_spans(docs: DataFrame, min_bytes: int = 100, broadcast_ids: int = 1_000_000, sample_share: float = 0.02, sample_least: int = 64) -> DataFrame:
    """(doc_id, version, start, end) of ``docs`` (doc_id, version, text): bytes covered by a string of ``min_bytes`` bytes that also starts earlier.

    Earlier is a smaller doc_id, of equal ones a smaller version, or a smaller start in the same
    document. Spans may overlap.
    """
    docs = docs.where("doc_id is not null")
    rows = docs.where("text is not null").mapInArrow(find_segments(min_bytes), SEGMENTS)
    rows = dealt_out(rows, crowded_anchors(docs, min_bytes, sample_share, sample_least), broadcast_ids)
    same = Window.partitionBy("anchor", "salt", "content").orderBy("doc_id", "version", "start")
    of_anchor = Window.partitionBy("anchor", "salt")
    # A rank: rows that repeat an id and a text are at the same place, so none is later than the other.
    met = rows.withColumn("nth", F.rank().over(same))
    met = met.withColumn("several", (F.col("salt") != 0) | (F.min("content").over(of_anchor) != F.max("content").over(of_anchor)))
    met = met.withColumn("firsts", F.when(F.col("salt") != 0, F.lit(HOT + 1)).otherwise(F.count(F.when(F.col("nth") == 1, 1)).over(of_anchor)))
    met = saved(met.where("content is null or nth > 1 or several"), "anchors")
    known = met.where("content is null").select("doc_id", "version", "start", (F.col("start") + F.col("shape")).alias("end"))
    again = met.where("content is not null and nth > 1")
    again = again.select("doc_id", "version", "start", (F.col("start") + F.shiftright("shape", 8) + (min_bytes - 1)).alias("end"))
    open_ = met.where("content is not null and nth = 1 and several")
    found = open_.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "shape", "anchor", (F.col("firsts") > HOT).alias("hot"))).alias("found"))
    found = saved(found, "open")
    key = ["doc_id", "version"]
    cut = docs.join(small(found.select(*key), broadcast_ids), key, "left_semi").join(found, key).select(*key, "text", "found")
    cut = saved(cut.mapInArrow(cut_segments(min_bytes), "key long, doc_id long, version long, start int, bytes binary, end int"), "cut")
    told = cut.where("end is not null").select(*key, "start", "end")
    rest = cut.where("end is null").select("key", *key, "start", "bytes")
    full = saved(rest.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FULL).select("key"), "full")
    spans = known.unionByName(again).unionByName(told)
    if not full.isEmpty():
        full = small(full, broadcast_ids)
        hot = rest.join(full, "key", "left_semi").select(*key, "start", "bytes")
        spans = spans.unionByName(later_windows(hot, min_bytes))
        rest = rest.join(full, "key", "left_anti")
    met = rest.repartition("key").sortWithinPartitions("key").mapInArrow(later_occurrences(min_bytes), REPEATS)
    return spans.unionByName(met)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow on (doc_id, text, starts, ends): the row of ``KEPT`` of each document."""
    for batch in batches:
        rows = []
        for doc_id, text, starts, ends in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            digest, at, removed, runs = hashlib.sha256(), 0, 0, 0
            if starts:
                zeros = np.zeros(len(starts), np.int64)
                _, first, last = merged(zeros, np.array(starts, np.int64), np.array(ends, np.int64))
                for s, e in zip(first.tolist(), last.tolist()):
                    digest.update(raw[at:s])
                    at, removed, runs = e, removed + e - s, runs + 1
            digest.update(raw[at:])
            rows.append((doc_id, len(raw), removed, runs, digest.hexdigest()))
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], [x.split()[0] for x in KEPT.split(", ")])


def repeat_dedup(docs: DataFrame, min_bytes: int = 100, broadcast_ids: int = 1_000_000, **sampling) -> DataFrame:
    """``KEPT`` for each row of ``docs``: doc_id, text, with all later occurrences of long strings taken out.

    Texts are UTF-8 bytes; matches never cross documents. Null and empty texts and texts shorter
    than ``min_bytes`` lose nothing. A row without a doc_id has no place in the order: it loses
    nothing and takes nothing from others. Rows that repeat id and text are one document that is
    returned as often; different texts of one id are documents in order of their 64-bit hash. A
    very long text is cut in parts that overlap by a window, each of bounded size in a task, but for its
    own bytes. An empty table gives no rows. Other columns, whatever their names, are not read.

    Whole segments are told apart by two 64-bit hashes, of their anchor and of their content, without a look at
    their bytes. Segments of different anchors need both to agree; 10^8 different ones around one anchor are
    all told apart but for a chance of 3 in 10^4.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    spans = repeated_spans(docs, min_bytes, broadcast_ids, **sampling)
    key = ["doc_id", "version"]
    spans = saved(spans.groupBy(*key).agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")), "spans")
    ids = small(spans.select(*key), broadcast_ids)
    none = F.lit(None).cast("array<int>")
    hit = docs.join(ids, key, "left_semi").join(spans, key).select("doc_id", "text", "starts", "ends")
    free = docs.join(ids, key, "left_anti").select("doc_id", "text", none.alias("starts"), none.alias("ends"))
    return hit.mapInArrow(take_out, KEPT).unionByName(free.mapInArrow(take_out, KEPT))


#: The query over documents in DuckDB, by every window of 100 bytes in hexadecimal.
DOCUMENTS_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, s, substr(x, 2 * s + 1, 200) AS g
      FROM (SELECT doc_id, x, unnest(range(0, greatest(len(x) // 2 - 99, 0))) AS s FROM h)),
d AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1),
m AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER o <= 100 THEN 0 ELSE 1 END AS new FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
k AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS i FROM m),
r AS (SELECT doc_id, i, min(s) AS a, max(s) + 100 AS b FROM k GROUP BY doc_id, i),
c AS (SELECT h.doc_id, r.i, substr(x, 2 * coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY i), 0) + 1,
             2 * (a - coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY i), 0))) AS y FROM h JOIN r USING (doc_id)),
g AS (SELECT doc_id, string_agg(y, '' ORDER BY i) AS y FROM c GROUP BY doc_id),
v AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(y, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN v USING (doc_id) LEFT JOIN g USING (doc_id)
"""
