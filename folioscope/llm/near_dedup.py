"""Near-duplicate documents by one-permutation MinHash with optimal densification.

Each distinct shingle falls into one of 128 bins by one hash and the smallest of each bin is
kept; an empty bin takes the value of the bin that its own sequence of random bins reaches
first. Groups of four slots are the keys of 32 buckets. In each bucket, the most central document
is linked to all others, so candidates are as many as bucket members. Candidates are confirmed
on their full shingle sets. What the stars leave apart meets once more, under the rarest shingles of each
document, of which similar ones share at least one, so that no link between different texts is lost.

A link of similarity 0.8 is missed by all 32 buckets with a chance of about 5 in 10^8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import saved, small, tidied
from folioscope.llm.components import components
from folioscope.llm.words import BASE, Words, distinct, lower_ascii, mix, pieces, runs_of

BINS, BAND = 128, 4
TRIES = 512
#: Members of a star that meet one copy of its hub's set.
MEMBERS = 256
#: Members of a shingle that meet in pairs; more meet in blocks.
FEW = 64
#: Shingles of a block in the comparison of what the stars leave apart.
BLOCK = 1 << 17


def random_bins() -> np.ndarray:
    """For each bin, the sequence of bins that it tries when empty."""
    n = np.arange(BINS * TRIES, dtype=np.uint64).reshape(BINS, TRIES)
    return (mix(mix(n + np.uint64(1)) * np.uint64(BASE)) >> np.uint64(57)).astype(np.int64)


def signatures(rows: np.ndarray, h: np.ndarray, n_rows: int) -> np.ndarray:
    """(n_rows, 128) slots for the distinct (row, shingle hash) in order; zeros for a row without any."""
    slots = np.zeros((n_rows, BINS), np.uint64)
    full = np.zeros((n_rows, BINS), bool)
    bins = (h >> np.uint64(57)).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (bins[1:] != bins[:-1])
    slots[rows[first], bins[first]] = h[first]
    full[rows[first], bins[first]] = True
    tries = random_bins()
    row, empty = np.nonzero(~full & full.any(axis=1)[:, None])
    for t in range(TRIES):
        if not len(row):
            break
        source = tries[empty, t]
        found = full[row, source]
        slots[row[found], empty[found]] = slots[row[found], source[found]]
        row, empty = row[~found], empty[~found]
    if len(row):
        slots[row, empty] = slots[row, full[row].argmax(axis=1)]
    return slots


def shingle_sets(column: pa.Array, k: int, words: Words) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, row, shingle hash) for runs of rows; distinct and in order."""
    for i, j, data, at in pieces(column):
        data = lower_ascii(data)
        rows, starts, ends = words.find(data, at)
        rows, h = runs_of(rows, words.hashes(data, starts, ends), k, j - i)
        yield i, j, *distinct(rows, h)


def sketch(k: int):
    """For mapInArrow on (doc_id, text): size, hash of the whole set and bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for i, j, rows, h in shingle_sets(batch.column(1), k, words):
                n = np.bincount(rows, minlength=j - i)
                starts = np.cumsum(n) - n
                # Two sums of mixed hashes tell sets apart.
                sums = [np.zeros(len(h) + 1, np.uint64) for _ in range(2)]
                np.cumsum(mix(h), out=sums[0][1:])
                np.cumsum(mix(h ^ np.uint64(BASE)), out=sums[1][1:])
                keys = [(s[starts + n] - s[starts]).view(np.int64) for s in sums]
                slots = signatures(rows, h, j - i)
                bands = np.zeros((j - i, BINS // BAND), np.uint64)
                for b in range(BINS // BAND):
                    acc = np.full(j - i, b, np.uint64)
                    for s in range(BAND):
                        acc = mix(acc * np.uint64(BASE) + slots[:, b * BAND + s])
                    bands[:, b] = acc
                some = n > 0
                offsets = np.concatenate([[0], np.cumsum(some * (BINS // BAND))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(n, pa.int64()),
                        pa.array(keys[0]),
                        pa.array(keys[1]),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[some].ravel().view(np.int64))),
                    ],
                    ["doc_id", "n", "k1", "k2", "bands"],
                )

    return run


def full_sets(k: int):
    """For mapInArrow on (doc_id, text): the whole shingle set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for i, j, rows, h in shingle_sets(batch.column(1), k, words):
                offsets = np.searchsorted(rows, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))], ["doc_id", "shingles"])

    return run


def shingle_table(ids: DataFrame, docs: DataFrame, k: int, broadcast_ids: int) -> DataFrame:
    """(doc_id, shingles) for the documents in ``ids``, written once.

    Up to ``broadcast_ids`` ids are broadcast to pick their texts; beyond, the texts are joined by id.
    """
    own = docs.join(small(saved(ids.distinct(), "ids"), broadcast_ids), "doc_id", "left_semi")
    return saved(own.mapInArrow(tidied(full_sets(k)), "doc_id long, shingles array<long>"), "sets")


def in_blocks(star: DataFrame, broadcast_ids: int) -> tuple[DataFrame, DataFrame]:
    """(``star`` with block, (hub, block) of each hub): stars of many members are dealt out, ``MEMBERS`` to a block."""
    sizes = star.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks"))
    large = small(saved(sizes.where("blocks > 1"), "large-stars"), broadcast_ids)
    dealt = star.join(large, "hub", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.lit(0)))
    hubs = star.select("hub").distinct().join(large, "hub", "left")
    return dealt.drop("blocks"), hubs.select("hub", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"))


def confirmed(star: DataFrame, sets: DataFrame, num: int, den: int, broadcast_ids: int) -> DataFrame:
    """The (hub, rep) of ``star`` with den * shared >= num * united on their full sets; a hub's set goes to each of its blocks."""
    dealt, hubs = in_blocks(star, broadcast_ids)
    hubs = sets.toDF("hub", "x").join(hubs, "hub")
    met = dealt.join(sets.toDF("rep", "y"), "rep").join(hubs, ["hub", "block"]).withColumn("shared", F.size(F.array_intersect("x", "y")))
    united = F.size("x") + F.size("y") - F.col("shared")
    return met.where(F.lit(den) * F.col("shared") >= F.lit(num) * united).select("hub", "rep").distinct()


def compare_blocks(num: int, den: int):
    """For cogroups of (outsiders, members) of a shingle: links between different components, confirmed on full sets.

    A small inverted index of the members' shingles counts what an outsider shares with each. Of
    the links of an outsider to one component, one goes out.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            sizes = right.shingles.map(len).to_numpy()
            flat = np.concatenate(right.shingles.to_list())
            order = np.argsort(flat, kind="stable")
            flat, member = flat[order], np.repeat(np.arange(len(right)), sizes)[order]
            comps, reps = right.comp.to_numpy(), right.rep.to_numpy()
            for rep, comp, own in zip(left.rep, left.comp, left.shingles):
                first, last = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                n = last - first
                at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                shared = np.bincount(member[at], minlength=len(right))
                linked = (den * shared >= num * (sizes + len(own) - shared)) & (comps != comp)
                _, one = np.unique(comps[linked], return_index=True)
                out += [(rep, x) for x in reps[linked][one]]
        return pd.DataFrame(out, columns=["hub", "rep"], dtype="int64")

    return run


def residual(star: DataFrame, comps: DataFrame) -> DataFrame:
    """(rep, comp): members of stars that confirmation left in several components.

    Documents that share a bucket share its hub, so any pair of a bucket that is still apart is a pair of these.
    """
    own = star.union(star.select("hub", "hub").distinct()).join(comps, F.col("rep") == F.col("node"), "left").select("hub", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = own.groupBy("hub").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high")
    return own.join(mixed, "hub").select("rep", "comp").distinct()


def rare_shingles(members: DataFrame, num: int, den: int) -> DataFrame:
    """(shingle, rep, comp, n, place): the rarest shingles of each member (rep, comp, shingles), as many as one of them must be shared.

    In one order of all shingles, rarest among the members first, two sets of similarity num / den share one of their first
    n - ceil(num * n / den) + 1. Shingles that one member alone has come first and cannot be shared, so they take places and no rows.
    """
    each = members.select("rep", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = each.join(often, "shingle").groupBy("rep", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("own"))
    alone = F.col("n") - F.size("own")
    first = F.col("n") - F.expr(f"CAST(({num} * CAST(n AS BIGINT) + {den - 1}) DIV {den} AS INT)") + 1
    taken = ordered.withColumn("alone", alone).select("rep", "comp", "n", "alone", F.posexplode(F.slice("own", F.lit(1), F.greatest(first - alone, F.lit(0)))).alias("i", "x"))
    return taken.select("x.shingle", "rep", "comp", "n", (F.col("alone") + F.col("i")).alias("place"))


def linked_pairs(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (hub, rep) between rows of a shingle with few members, confirmed on full sets.

    Pairs go on if their sizes, and the places of the first shingle they share, leave room for the similarity.
    """
    one = rows.select("shingle", *(F.col(c).alias(f"{c}1") for c in ("rep", "comp", "n", "place")))
    met = one.join(rows, "shingle").where((F.col("rep1") < F.col("rep")) & (F.col("comp1") != F.col("comp")))
    room = 1 + F.least(F.col("n1") - F.col("place1"), F.col("n") - F.col("place")) - 1
    met = met.where((num + den) * room.cast("long") >= num * (F.col("n1") + F.col("n")).cast("long")).select(F.col("rep1").alias("hub"), "rep").distinct()
    met = met.join(sets.toDF("hub", "x"), "hub").join(sets.toDF("rep", "y"), "rep").withColumn("shared", F.size(F.array_intersect("x", "y")))
    united = F.size("x") + F.size("y") - F.col("shared")
    return met.where(F.lit(den) * F.col("shared") >= F.lit(num) * united).select("hub", "rep")


def linked_blocks(rows: DataFrame, sets: DataFrame, num: int, den: int, broadcast_ids: int) -> DataFrame:
    """Links (hub, rep) between rows of a shingle with many members: those outside its largest component meet all, in blocks.

    Blocks of about ``BLOCK`` shingles meet as many, dealt out by shingle and block.
    """
    per = rows.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("shingle").agg(F.max(F.struct("m", "comp"))["comp"].alias("main"))
    met = rows.join(small(saved(per, "largest"), broadcast_ids), "shingle").join(sets.withColumn("n", F.size("shingles")).withColumnRenamed("doc_id", "rep"), "rep")
    met = saved(met.select(F.col("shingle").alias("hub"), "rep", "comp", "main", "shingles", F.size("shingles").alias("n")), "residual")
    outside = F.col("comp") != F.col("main")
    blocks = lambda n: F.ceil(F.coalesce(F.sum(n), F.lit(1)) / BLOCK).cast("int")
    sizes = met.groupBy("hub").agg(blocks(F.when(outside, F.col("n"))).alias("lefts"), blocks(F.col("n")).alias("rights"))
    met = met.join(small(saved(sizes, "block-sizes"), broadcast_ids), "hub")
    spread = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cols, key = ["hub", "i", "j", "rep", "comp", "shingles"], ["hub", "i", "j"]
    left = met.where(outside).withColumn("i", spread("lefts")).withColumn("j", each("rights")).selectExpr(*cols)
    right = met.withColumn("j", spread("rights")).withColumn("i", each("lefts")).selectExpr(*(f"{c} as {c}" for c in cols))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare_blocks(num, den), "hub long, rep long")


def rest(star: DataFrame, sets: DataFrame, comps: DataFrame, num: int, den: int, broadcast_ids: int) -> DataFrame:
    """Links (hub, rep) between documents that share a bucket, are similar, and that confirmation left in different components.

    Only members that share one of their rarest shingles can be similar; they meet under it. Pages of one template have rare shingles
    of their own, so however many there are, few meet.
    """
    members = saved(residual(star, comps).join(sets.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "comp", "shingles"), "members")
    rows = saved(rare_shingles(members, num, den), "rare")
    shared = rows.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("c")).where("low != high")
    rows = saved(rows.join(shared.select("shingle", "c"), "shingle"), "shared")
    pairs = linked_pairs(rows.where(F.col("c") <= FEW), sets, num, den)
    many = rows.where(F.col("c") > FEW)
    return saved(pairs if many.isEmpty() else pairs.unionByName(linked_blocks(many.drop("n"), sets, num, den, broadcast_ids)), "rest")


def near_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, broadcast_ids: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``: doc_id, text.

    Words are runs of anything but ASCII white space, with A-Z in lower case. A set holds the
    distinct shingles of ``k`` words; with fewer words, the whole sequence. Documents are linked
    where den * shared >= num * united. component_id is the smallest doc_id reachable, and kept
    says that it is the row's own.

    A text that is null or without words has an empty set and no links. Rows without a doc_id
    are linked with nothing, have no component and are kept. Rows that repeat an id are the
    same document, so they share a component; linked texts of either join theirs. An empty
    table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = saved(docs.mapInArrow(tidied(sketch(k)), "doc_id long, n long, k1 long, k2 long, bands array<long>"), "sketches")
    some = rows.where("n > 0 and doc_id is not null")
    # Equal sets are one representative, told by size and two hashes.
    key = ["n", "k1", "k2"]
    reps = saved(some.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands")), "representatives")
    keyed = reps.select("rep", F.explode("bands").alias("band"))
    sizes = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    buckets = saved(keyed.join(sizes, "band"), "buckets")
    central = buckets.groupBy("rep").agg(F.sum("c").alias("central"))
    ranked = buckets.join(central, "rep").select("band", "rep", F.struct("central", (-F.col("rep")).alias("r")).alias("rank"))
    hubs = ranked.groupBy("band").agg((-F.max("rank")["r"]).alias("hub"))
    star = saved(ranked.join(hubs, "band").where("rep != hub").select("hub", "rep").distinct(), "stars")
    sets = shingle_table(star.select(F.col("rep").alias("doc_id")).union(star.select("hub")), docs, k, broadcast_ids)
    links = saved(confirmed(star, sets, num, den, broadcast_ids), "confirmed")
    comps = components(links, "hub", "rep", broadcast_ids)
    # Components found so far are stars of few rounds; what is found beside them ties some together.
    links = comps.toDF("rep", "hub").select("hub", "rep").union(rest(star, sets, comps, num, den, broadcast_ids))
    # Rows of one id with different texts tie their representatives together.
    tied = some.join(reps.select(*key, "rep"), key).groupBy("doc_id").agg(F.min("rep").alias("hub"), F.max("rep").alias("rep"))
    comps = components(links.union(tied.where("hub != rep").select("hub", "rep")), "hub", "rep", broadcast_ids)
    groups = reps.select(*key, "rep").join(comps, F.col("rep") == F.col("node"), "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    groups = groups.withColumnsRenamed({"n": "n_", "k1": "k1_", "k2": "k2_"})
    out = rows.select("doc_id", *key).join(groups, (F.col("n") == F.col("n_")) & (F.col("k1") == F.col("k1_")) & (F.col("k2") == F.col("k2_")) & F.col("doc_id").isNotNull(), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, broadcast_ids: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest id of its near-duplicate component; columns as they are.

    Rows without an id or without words are kept; rows that repeat a kept id are kept with it.
    """
    gone = saved(near_components(docs, k, num, den, broadcast_ids).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.alias("d").join(small(gone, broadcast_ids).alias("g"), F.col("d.doc_id") == F.col("g._gone"), "left_anti")


#: The query over documents with shingles of four words, in DuckDB: all pairs that share a shingle.
DOCUMENTS_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM t UNION SELECT l.b, r.m FROM r JOIN l ON r.doc_id = l.a WHERE r.m < l.b),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, t.doc_id = c.component_id AS kept
FROM t JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
