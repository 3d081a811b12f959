"""Collocations: phrases of two to four words scored by their weakest cut, mined by pivot partitioning.

Words are numbered by frequency. The pivot of a phrase is its rarest word, the leftmost of equals. For
each place of a text the words around it that a phrase with its pivot there can hold are rewritten as
one fragment of at most seven numbers; infrequent words end fragments. Fragments, counted where they
are equal, travel to their pivot; a task counts the phrases of its pivots that hold the pivot's
place, and so emits each phrase from one pivot only, with its whole count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import saved, small
from folioscope.llm.passages import batch_of
from folioscope.llm.tokens import Splitter, bytes_table
from folioscope.llm.words import mix

#: Longest phrase, in words.
LONGEST = 4
#: What ends a piece, and what separates words inside it.
BREAKS = bytes_table((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
SEPARATORS = BREAKS | bytes_table((0x09, 0x09), (0x20, 0x20))
#: Bytes of text whose fragments are counted together in a task.
TOGETHER = 4 << 20
#: Words of a text whose fragments are cut together.
SPAN = 1 << 20
#: Fragments of a pivot that one task may gather; those of a more frequent one are dealt out by content.
SPLIT = 1_000_000
#: A word without a number, because more are frequent than are sent to tasks: this bit, and its hash.
NAMELESS = 1 << 62

WORDS = "lang string, word string, hash long, n long"


def of_lang(hashes: np.ndarray, lang: str) -> np.ndarray:
    """Hashes of words as those of a language's words: equal words of two languages differ."""
    return mix(hashes ^ np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")))


def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """(lang, texts) of a batch's rows."""
    langs = batch.column(0).dictionary_encode()
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, batch.column(1).filter(pa.compute.equal(langs.indices, i))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow on (lang, text): rows of ``WORDS``, the words of runs of texts with how often they stand there."""
    splitter = Splitter(SEPARATORS, lower=True)
    for batch in batches:
        for lang, texts in by_lang(batch):
            for run in splitter.runs(texts):
                hashes, at, n = np.unique(run.hash, return_index=True, return_counts=True)
                if len(hashes):
                    words = pa.array(run.words(at), pa.binary()).cast(pa.string())
                    columns = [pa.array([lang] * len(hashes)), words, pa.array(of_lang(hashes, lang).view(np.int64)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "hash", "n"])


class Numbers:
    """The numbers of the frequent words that tasks know: 0 for the most frequent one of all languages, and so on.

    ``complete`` if those are all; else an unknown word may be frequent, and stands as ``NAMELESS`` with its hash.
    """

    def __init__(self, hashes: np.ndarray, n: np.ndarray, complete: bool):
        self.complete = complete
        hashes = hashes.view(np.uint64)
        rank = np.lexsort((hashes, -n))
        #: How often the word of each number stands in its language.
        self.n = n[rank]
        #: The number of each of ``hashes``.
        self.number = np.empty(len(n), np.int64)
        self.number[rank] = np.arange(len(n))
        order = np.argsort(hashes)
        self.known, self.of_known = hashes[order], self.number[order]

    def find(self, lang: str, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for those that are not frequent."""
        hashes = of_lang(hashes, lang)
        none = np.full(len(hashes), -1) if self.complete else (NAMELESS | (hashes >> np.uint64(2)).astype(np.int64))
        if not len(self.known):
            return none
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.of_known[at], none)


def nameless(hash_: Column) -> Column:
    """``Numbers.find`` of a word that tasks do not know, as a column."""
    return F.shiftrightunsigned(hash_, 2).bitwiseOR(F.lit(NAMELESS))


FRAGMENTS = "pivot long, salt long, fragment binary, n long"
#: Places of a fragment: the pivot, and as many words on either side as a phrase can have beside it.
PLACES = 2 * LONGEST - 1


def fragments_of(ids: np.ndarray, piece: np.ndarray, first: int, last: int) -> np.ndarray:
    """A row of ``PLACES`` numbers for each place from ``first`` to ``last`` that is the pivot of any phrase: the words around it, -1 where no phrase reaches.

    Words left of a pivot are more frequent than it, those to its right at least as frequent.
    """
    reach, n = LONGEST - 1, len(ids)
    out = np.full((n, PLACES), -1, ids.dtype)
    out[:, reach] = ids
    for side in (-1, 1):
        going = ids >= 0
        for step in range(1, min(reach, n - 1) + 1):
            own, other = (slice(step, n), slice(0, n - step)) if side < 0 else (slice(0, n - step), slice(step, n))
            near = np.zeros(n, bool)
            near[own] = (piece[own] == piece[other]) & (ids[other] >= 0) & ((ids[other] < ids[own]) if side < 0 else (ids[other] <= ids[own]))
            going &= near
            at = np.flatnonzero(going)
            out[at, reach + side * step] = ids[at + side * step]
    out = out[first:last]
    return out[(out[:, reach - 1] >= 0) | (out[:, reach + 1] >= 0)]


def counted(rows: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sums of ``n``) of a matrix of numbers."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    order = np.lexsort(rows.T)
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]))
    return rows[first], np.add.reduceat(n[order] if n is not None else np.ones(len(rows), np.int64), first)


def binary_rows(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def find_fragments(numbers, split: int):
    """For mapInArrow on (lang, text): rows of ``FRAGMENTS``, with how often each is in some megabytes of text.

    Fragments of pivots that stand over ``split`` times are dealt out by a salt above 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Numbers = numbers.value
        kind = np.int32 if table.complete else np.int64
        splitter = Splitter(SEPARATORS, lower=True)
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows, n = counted(np.concatenate(held))
            pivot = rows[:, LONGEST - 1].astype(np.int64)
            known = pivot < len(table.n)
            shares = np.ones(len(rows), np.int64)
            shares[known] = table.n[pivot[known]] // split + 1
            mixed = (rows.astype(np.uint64) * np.arange(3, 2 * PLACES + 3, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(1) >> np.uint64(33)
            salt = np.where(shares > 1, 1 + mixed.astype(np.int64) % shares, 0)
            return batch_of(FRAGMENTS, [pivot, salt, binary_rows(rows), n])

        for batch in batches:
            for lang, texts in by_lang(batch):
                parts: list[tuple[np.ndarray, np.ndarray]] = []  # of a text that goes on
                ended = 0
                for words in splitter.runs(texts):
                    breaks = np.cumsum(BREAKS[words.data])
                    # Pieces grow with breaks, and with rows.
                    ids, piece = table.find(lang, words.hash).astype(kind), breaks[words.start] + words.row + ended
                    if words.goes_on or parts:
                        parts.append((ids, piece))
                        ended += int(breaks[-1])
                    size += len(words.data)
                    if words.goes_on:
                        continue
                    if parts:
                        ids, piece = (np.concatenate(x) for x in zip(*parts))
                        parts, ended = [], 0
                    for at in range(0, len(ids), SPAN):
                        begin = max(0, at - LONGEST + 1)
                        end = at + SPAN + LONGEST - 1
                        held.append(fragments_of(ids[begin:end], piece[begin:end], at - begin, at - begin + SPAN))
                    if size >= TOGETHER and held:
                        yield flush()
                        held.clear()
                        size = 0
        if held:
            yield flush()

    return run


#: A phrase's numbers, -1 beyond its last word, and how often it stands in the corpus.
PHRASES = "w1 long, w2 long, w3 long, w4 long, f long"
IDS = ["w1", "w2", "w3", "w4"]


def mine(least: int, chunk: int = 1 << 18):
    """For mapInArrow on ``FRAGMENTS`` in order of (pivot, salt): rows of ``PHRASES``, the phrases that the pivots own.

    A pivot that is wholly here leaves out what stands fewer than ``least`` times; of one in several shares, or
    longer than a chunk, all goes out, to be summed up.
    """
    reach = LONGEST - 1

    def phrases(rows: np.ndarray, n: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
        found, sums, keep = [], [], []
        for left in range(LONGEST):
            for right in range(LONGEST - left):
                if left + right:
                    good = np.flatnonzero((rows[:, reach - left] >= 0) & (rows[:, reach + right] >= 0))
                    own = np.full((len(good), LONGEST), -1, rows.dtype)
                    own[:, : left + right + 1] = rows[good, reach - left : reach + right + 1]
                    found.append(own)
                    sums.append(n[good])
                    keep.append(whole[good])
        rows, n, whole = np.concatenate(found), np.concatenate(sums), np.concatenate(keep)
        out, total = [], []
        for part in (True, False):
            own, sums_ = counted(rows[whole == part], n[whole == part])
            good = sums_ >= (least if part else 1)
            out.append(own[good])
            total.append(sums_[good])
        return batch_of(PHRASES, [*np.concatenate(out).astype(np.int64).T, np.concatenate(total)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, begun = 0, False  # begun: rows of the first pivot have gone out already

        def take(to: int) -> tuple[np.ndarray, ...]:
            nonlocal held, size
            both = [np.concatenate(x) for x in zip(*held)]
            out, held = [x[:to] for x in both], [tuple(x[to:] for x in both)]
            size = len(held[0][0])
            return tuple(out)

        for batch in batches:
            width = len(batch.column(2)[0].as_py()) // PLACES if batch.num_rows else 0
            if not width:
                continue
            column = batch.column(2)
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            rows = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.int32 if width == 4 else np.int64).reshape(-1, PLACES)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), rows, batch.column(3).to_numpy()))
            size += len(rows)
            while size >= chunk:
                pivot, salt = (np.concatenate(x) for x in list(zip(*held))[:2])
                edge = np.flatnonzero((pivot[1:] != pivot[:-1]) | (salt[1:] != salt[:-1])) + 1
                last = int(edge[-1]) if len(edge) else size
                pivot, salt, rows, n = take(last)
                whole = salt == 0
                if begun or not len(edge):
                    whole[: int(edge[0]) if len(edge) else last] = False
                begun = not len(edge)
                yield phrases(rows, n, whole)
        if size:
            pivot, salt, rows, n = take(size)
            whole = salt == 0
            if begun:
                edge = np.flatnonzero((pivot[1:] != pivot[:-1]) | (salt[1:] != salt[:-1])) + 1
                whole[: int(edge[0]) if len(edge) else size] = False
            yield phrases(rows, n, whole)

    return run


def part(first: int, last: int) -> Column:
    """The numbers of a phrase's words from ``first`` to ``last`` (exclusive), as a phrase."""
    own = [F.col(c) for c in IDS[first:last]]
    return F.struct(*(x.alias(c) for x, c in zip(own + [F.lit(-1).cast("long")] * (LONGEST - len(own)), IDS)))


def frequent_words(texts: DataFrame, least: int, max_words: int) -> tuple[DataFrame, DataFrame, Numbers]:
    """(lang, word, id, f) of the words that stand ``least`` times in a language, (lang, n) of all words, and what tasks are sent."""
    spark = texts.sparkSession
    words = saved(texts.mapInArrow(count_words, WORDS).groupBy("lang", "word", "hash").agg(F.sum("n").alias("n")), "words")
    often = words.where(F.col("n") >= least)
    complete = often.count() <= max_words
    told = often if complete else often.orderBy(F.desc("n"), "lang", "word").limit(max_words)
    told = told.select("hash", "n").toArrow()
    numbers = Numbers(told.column("hash").to_numpy(), told.column("n").to_numpy(), complete)
    named = spark.createDataFrame(pa.table({"hash": told.column("hash"), "id": numbers.number}))
    own = often.join(F.broadcast(named) if len(told) <= 100_000 else named, "hash", "left")
    own = own.select("lang", "word", F.coalesce("id", nameless(F.col("hash"))).alias("id"), F.col("n").alias("f"))
    return saved(own, "named"), words.groupBy("lang").agg(F.sum("n").alias("n")), numbers


def frequent_phrases(texts: DataFrame, numbers: Numbers, least: int, split: int) -> DataFrame:
    """``PHRASES`` of two words or more that stand ``least`` times."""
    sent = texts.sparkSession.sparkContext.broadcast(numbers)
    fragments = texts.mapInArrow(find_fragments(sent, split), FRAGMENTS)
    dealt = fragments.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt")
    found = dealt.mapInArrow(mine(least), PHRASES).groupBy(*IDS).agg(F.sum("f").alias("f"))
    return saved(found.where(F.col("f") >= least), "phrases")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, scale: int = 2_000_000, drop: tuple[int, int] = (80, 100), max_words: int = 2_000_000, split: int = SPLIT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of each language of ``docs`` (lang, text).

    Phrases are two to four words of one piece, a text's run between punctuation and line ends; A-Z are
    lower-cased. A phrase stands a times, ``least`` at least; of its cuts into a first part (l times) and a rest (r times) the one of lowest
    score ``scale`` * a div (l + r) counts, the earliest of equals. Left out are phrases inside a longer one that stands ``drop``
    as often (80 of 100). n is all words of the language. Equal scores go by a, then by the phrase's bytes.

    Null and empty texts have no words, a null language is ``und``; repeated rows count as often; an empty table and languages
    without such phrases give no rows. Texts are taken whole, very long ones in parts that share words. Other columns are not read.

    Tasks know at most ``max_words`` frequent words by number. Where more are frequent, the others go by
    their 62-bit hash and are ranked as rarer: fragments are longer then, the results the same.
    Words are told by 64-bit hashes.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    words, totals, numbers = frequent_words(texts, least, max_words)
    found = frequent_phrases(texts, numbers, least, split)
    none = F.lit(-1).cast("long")
    counts = found.select(F.struct(*IDS).alias("key"), "f").unionByName(words.select(F.struct(F.col("id").alias("w1"), *(none.alias(c) for c in IDS[1:])).alias("key"), "f"))
    size = 2 + (F.col("w3") >= 0).cast("int") + (F.col("w4") >= 0).cast("int")
    found = found.withColumn("size", size)
    cuts = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), part(0, k).alias("first"), part(k, LONGEST).alias("rest")) for k in range(1, LONGEST))), lambda c: c.k < F.col("size"))
    cut = found.select(*IDS, "f", F.explode(cuts).alias("c")).select(*IDS, "f", "c.*")
    cut = cut.join(counts.select(F.col("key").alias("first"), F.col("f").alias("l")), "first").join(counts.select(F.col("key").alias("rest"), F.col("f").alias("r")), "rest")
    score = F.expr(f"CAST(CAST(f AS DECIMAL(20, 0)) * CAST({scale} AS DECIMAL(10, 0)) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0))) AS BIGINT)")
    scored = cut.withColumn("score", score).groupBy(*IDS, "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    inside = [(i, j) for i in range(LONGEST) for j in range(i + 2, LONGEST + 1) if (i, j) != (0, LONGEST)]
    within = F.filter(F.array(*(F.struct(F.lit(j).alias("end"), F.lit(j - i).alias("n"), part(i, j).alias("key")) for i, j in inside)), lambda x: (x.end <= F.col("size")) & (x.n < F.col("size")))
    longer = found.where("size > 2").select("f", F.explode(within).alias("x")).groupBy("x.key").agg(F.max("f").alias("longer"))
    kept = scored.join(longer.select("key.*", "longer"), IDS, "left")
    often = F.expr(f"CAST({drop[1]} AS DECIMAL(10, 0)) * CAST(longer AS DECIMAL(20, 0)) >= CAST({drop[0]} AS DECIMAL(10, 0)) * CAST(f AS DECIMAL(20, 0))")
    kept = kept.where(F.col("longer").isNull() | ~often).select(*IDS, "f", "s.score", "s.l", "s.r")
    spelled = kept.select("*", F.posexplode(F.array(*IDS)).alias("at", "id")).where("id >= 0").join(small(words.select("id", "lang", "word"), 200_000), "id")
    each = [F.max(F.when(F.col("at") == i, F.col("word"))) for i in range(LONGEST)]
    named = spelled.groupBy(*IDS, "f", "score", "l", "r").agg(F.min("lang").alias("lang"), F.concat_ws(" ", *each).alias("phrase"))
    # First in 64 shares of a language's phrases, as one language may have most of all.
    order = [F.desc("score"), F.desc("f"), "phrase"]
    shares = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    ranked = named.withColumn("rank", F.row_number().over(shares.orderBy(*order))).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


#: The query over documents in DuckDB, by all runs of one to four words.
DOCUMENTS_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[.,;:!?
-
]') AS p FROM documents),
x AS (SELECT lang, regexp_extract_all(unnest(p), '[^ 	]+') AS w FROM d),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM x, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM x GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.k, a, cut, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * a) // (l.f::HUGEINT + r.f) AS BIGINT) AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ')
      JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(w[u:u + m - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT DISTINCT lang, w, k, a, m, unnest(range(1, k - m + 2)) AS u FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b JOIN n USING (lang) LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a
QUALIFY rank <= 2000
"""
