"""Ranked lexical search: postings in fixed windows of documents, scored by scatter-add.

Documents are indexed where they lie. A task numbers its documents window by window, in order of their
ids, and keeps the postings of the asked terms as one row a window: which slots hold a term, how often.
A search traverses the postings of an item's terms inside a window, adds their weights into an array
with a place for each slot, marks the slots it touches, and harvests the marked ones into the item's
heap. Postings are never shuffled; what moves are counts of terms and a task's ten best of each item.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import saved
from folioscope.llm.tokens import Splitter, bytes_table

#: Documents of a window: sums and marks of so many slots stay in a core's cache.
WINDOW = 1 << 14
#: A term: a run of anything but ASCII that is no letter and no digit.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATORS = bytes_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SEGMENTS = "doc_ids array<long>, lengths array<long>, terms array<int>, counts array<long>, slots array<int>, tfs array<long>"


class Terms:
    """The numbers of asked terms: told by hash, and confirmed on their bytes."""

    def __init__(self, terms: list[bytes], splitter: Splitter):
        text = np.frombuffer(b"".join(terms), np.uint8)
        self.size = np.array([len(t) for t in terms], np.int64)
        self.base = np.cumsum(self.size) - self.size
        self.text = text
        hashes = splitter.hasher.hashes(text, self.base, self.base + self.size) if terms else np.zeros(0, np.uint64)
        self.number = np.argsort(hashes, kind="stable")
        self.hash = hashes[self.number]
        if len(self.hash) > 1 and (self.hash[1:] == self.hash[:-1]).any():
            raise ValueError("two terms have one hash")

    def find(self, run) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of the words of ``run`` that are asked terms."""
        if not len(self.hash) or not len(run.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hash, run.hash), len(self.hash) - 1)
        hit = np.flatnonzero(self.hash[at] == run.hash)
        number = self.number[at[hit]]
        size = run.end[hit] - run.start[hit]
        right = size == self.size[number]
        for length in np.unique(size[right]).tolist():
            these = np.flatnonzero(right & (size == length))
            # Bounded slices: a matrix of bytes for so many words at a time.
            for part in np.array_split(these, max(1, len(these) * length >> 22)):
                own = run.data[run.start[hit[part]][:, None] + np.arange(length)]
                right[part] = (own == self.text[self.base[number[part]][:, None] + np.arange(length)]).all(1)
        return run.row[hit[right]], number[right]


def index_windows(terms: list[bytes], window: int = WINDOW):
    """For mapInArrow on (doc_id, text): a row of ``SEGMENTS`` for each window of a task's documents."""

    def segment(ids: list[pa.Array], lengths: list[np.ndarray], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        doc_ids = pa.concat_arrays(ids)
        place = np.empty(len(doc_ids), np.int64)
        # Slots in order of ids, null last: of equal scores the smaller slot is first.
        order = pa.compute.sort_indices(doc_ids, null_placement="at_end").to_numpy()
        place[order] = np.arange(len(order))
        slot, term = place[np.concatenate([f[0] for f in found])], np.concatenate([f[1] for f in found])
        key, tf = np.unique(term * len(doc_ids) + slot, return_counts=True)
        own, counts = np.unique(key // len(doc_ids), return_counts=True)
        values = [
            doc_ids.take(pa.array(order)),
            pa.array(np.concatenate(lengths)[order]),
            pa.array(own.astype(np.int32)),
            pa.array(counts),
            pa.array((key % len(doc_ids)).astype(np.int32)),
            pa.array(tf),
        ]
        columns = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SEGMENTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(SEPARATORS, lower=True)
        asked = Terms(terms, splitter)
        ids, lengths, found, size = [], [], [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, window):
                part = batch.slice(first, window)
                if size and size + part.num_rows > window:
                    yield segment(ids, lengths, found)
                    ids, lengths, found, size = [], [], [], 0
                n = np.zeros(part.num_rows, np.int64)
                for words in splitter.runs(part.column(1)):
                    n[words.first : words.last] += np.bincount(words.row - words.first, minlength=words.last - words.first)
                    row, number = asked.find(words)
                    found.append((row + size, number))
                ids.append(part.column(0))
                lengths.append(n)
                size += part.num_rows
        if size:
            yield segment(ids, lengths, found)

    return run


def length_part(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """A document's m: 10 and nine tenths of its length, in hundredths of the mean."""
    if 90 * int(n.max(initial=0)) * docs < 1 << 63:
        return 10 + 90 * n * docs // max(total, 1)
    return np.array([10 + 90 * x * docs // total for x in n.tolist()], np.int64)


def score_windows(items: list[np.ndarray], weights: np.ndarray, docs: int, total: int, k: int):
    """For mapInArrow on ``SEGMENTS``: (item, doc_id, score) of the task's ``k`` best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list] = [[] for _ in items]
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, n, own, counts, slots, tfs = (batch.column(i)[row].values for i in range(6))
                n, own, counts, slots, tfs = (x.to_numpy() for x in (n, own, counts, slots, tfs))
                m = length_part(n, docs, total)
                added = np.repeat(weights[own], counts) * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[slots]))
                last = np.cumsum(counts)
                postings = {t: (slots[b - c : b], added[b - c : b]) for t, b, c in zip(own.tolist(), last.tolist(), counts.tolist())}
                sums, marked = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
                for heap, terms in zip(heaps, items):
                    for t in terms:
                        if t in postings:
                            at, more = postings[t]
                            sums[at] += more
                            marked[at] = True
                    hits = np.flatnonzero(marked)
                    scores = sums[hits]
                    sums[hits], marked[hits] = 0, False
                    good = scores >= max(1, heap[0][0] if len(heap) == k else 1)
                    hits, scores = hits[good], scores[good]
                    for i in np.lexsort((hits, -scores))[:k].tolist():
                        doc_id = doc_ids[int(hits[i])].as_py()
                        entry = (int(scores[i]), doc_id is not None, -(doc_id or 0))
                        (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, entry)
        rows = [(i, -d if known else None, s) for i, heap in enumerate(heaps) for s, known, d in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return run


def best(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each item with their ranks, first within 64 shares of the documents."""
    shares = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = rows.withColumn("rank", F.row_number().over(shares.orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, block_pairs: int = 1_000_000, window: int = WINDOW) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of ``docs`` (doc_id, text) that score highest for each of ``items`` (item_id, text).

    Every row of ``docs`` is a document: rows that repeat an id are ranked each, null ids come last among equal
    scores. Rows of ``items`` with one id (null is one) are one item with the terms of all. Null and empty texts have
    no terms: such documents are not found and do not count, such items find nothing; so do empty tables. A text of any
    length counts whole and is split in parts of a megabyte; other columns are not read.

    Items are taken in blocks of about ``block_pairs`` (item, term) pairs, each a pass over the documents, so what a task
    is sent is bounded.
    """
    spark = docs.sparkSession
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    pairs = saved(items.select("item_id", F.explode(words).alias("term")).distinct(), "terms")
    blocks = max(1, -(-pairs.count() // block_pairs))
    out = None
    for block in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        ids, number = np.unique(own.column("term").cast(pa.binary()).to_numpy(), return_inverse=True)
        keys, item = own.column("item_id").combine_chunks(), own.column("item_id").combine_chunks().dictionary_encode("encode")
        if not len(keys):
            continue
        rows = np.argsort(item.indices.to_numpy(), kind="stable")
        terms = np.split(number[rows], np.flatnonzero(np.diff(item.indices.to_numpy()[rows])) + 1)
        index = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(index_windows(ids.tolist(), window), SEGMENTS), "windows")
        holds = F.filter("lengths", lambda n: n > 0)
        docs_, total = index.select(F.size(holds).alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b).alias("l")).agg(F.sum("n"), F.sum("l")).first()
        df = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("e")).groupBy("e.terms").agg(F.sum("e.counts").alias("n")).collect()
        weights = np.zeros(len(ids), np.int64)
        for term, n in df:
            weights[term] = math.floor(1000 * math.log((2 * docs_ + 2) / (2 * n + 1)))
        found = index.mapInArrow(score_windows([t.tolist() for t in terms], weights, docs_ or 0, total or 0, k), "item int, doc_id long, score long")
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(item.dictionary)), pa.int32()), "item_id": item.dictionary}))
        ranked = best(found, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out


#: The query over documents and benchmark in DuckDB.
DOCUMENTS_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
                  regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM documents),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(t))::BIGINT AS total FROM d WHERE len(t) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
      FROM p, s WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
m AS (SELECT r, doc_id, 10 + (90 * len(t)::BIGINT * docs) // total AS m FROM d, s WHERE len(t) > 0),
c AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM c JOIN (SELECT r, doc_id FROM d) USING (r) WHERE score > 0
QUALIFY rank <= 10
"""
