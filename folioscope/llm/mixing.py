"""Mixing sources to target weights by Pareto order sampling.

A source's target is shared out among its documents in copies: a document's share grows with the
number of binary digits of its size, up to the largest repeat, so that long documents are taken
rather than short ones. The whole copies are certain. What is left is an inclusion probability p,
unequal within a source, and documents are ranked by (u / (1 - u)) / (p / (1 - p)), the random odds
over the inclusion odds. Those of lowest rank are the sample. Its size is fixed in words, as targets are: the sample ends
where the words wanted are reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import saved, small

#: A source's ranks are cut into cells of about CELL_ROWS documents, MAX_CELLS at most; only the
#: cell that holds the cut is put in order row by row.
CELL_ROWS, MAX_CELLS = 2000, 65536


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; null: 0. One more than the breaks of the trimmed text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def digits(size: Column) -> Column:
    """The binary digits of a size, 0 for 0: what a document's copies are in proportion to."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def source_targets(sizes: DataFrame, max_repeat: float, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, source_size, n_docs), one row a source.

    With level x, a source gets min(weight * x, max_repeat * size); the x at which the shares sum
    to all sizes is where resharing ends. It is found as resharing goes: each round fills the sources
    that the level before is too much for, by two sums over all sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # of a row for each source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = saved(sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(max_repeat))), "sources")
    total, level = s.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while True:
        full = F.col("most") / F.col("weight") < level
        filled, rest = s.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        after = (total - filled) / rest if rest else level
        if after <= level:
            break
        level = after
    return s.select("source", "source_size", "n_docs", F.least(F.col("weight") * F.lit(level), F.col("most")).alias("target"))


def class_levels(classes: DataFrame) -> DataFrame:
    """``classes`` with level: the x at which least(weight * x, most) sums to target within each source.

    Classes are in order of the level at which they are full. If those before one are full, running
    sums give the level of the rest; it is the one wanted at the first class that is not full at it.
    Levels only fall from there on. Classes without words take nothing.
    """
    s = classes.withColumn("full", F.when(F.col("weight") > 0, F.col("most") / F.col("weight")))
    by_full = Window.partitionBy("source").orderBy(F.col("full").asc_nulls_last(), "class")
    before = by_full.rowsBetween(Window.unboundedPreceding, -1)
    every = by_full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", F.when(rest > 0, (F.col("target") - filled) / rest))
    return s.withColumn("level", F.max(F.when(F.col("level") <= F.col("full"), F.col("level"))).over(every))


def class_copies(classes: DataFrame, targets: DataFrame, max_repeat: float) -> DataFrame:
    """(source, class, source_size, n_docs, target, whole, part, left): the copies of a source's documents by digits of their size.

    ``classes`` is (source, class, words, n), some sixty rows a source at most. A class gets class * x copies a document, up to
    ``max_repeat``, at the level x at which its source has its target.
    """
    c = classes.join(targets.withColumnsRenamed({"source": "_source"}), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    c = c.withColumns({"weight": (F.col("class") * F.col("words")).cast("double"), "most": F.col("words") * F.lit(float(max_repeat))})
    c = class_levels(c)
    copies = F.coalesce(F.least(F.col("class") * F.col("level"), F.lit(float(max_repeat))), F.lit(0.0))
    # Copies within a rounding error of a whole number are whole.
    c = c.withColumn("copies", copies).withColumn("whole", F.floor(F.col("copies") + 1e-9))
    c = c.withColumn("part", F.when(F.col("copies") - F.col("whole") > 1e-9, F.col("copies") - F.col("whole")).otherwise(0.0))
    left = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source"))
    return c.withColumn("left", left).select("source", "class", "source_size", "n_docs", "target", "whole", "part", "left")


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """``docs`` with _size, its words, and _u, a random number in (0, 1) from a hash of seed and doc_id."""
    random = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double")
    return docs.withColumns({"_size": n_words(F.col("text")), "_u": (random + 0.5) / F.lit(float(2**48))})


def odds(p: Column) -> Column:
    return p / (1 - p)


def cell() -> Column:
    """The cell of a row's rank r, by r / (1 + r), in which the ranks of a source spread over (0, 1); null without a part."""
    n_cells = F.least(F.ceil(F.col("n_docs") / CELL_ROWS), F.lit(MAX_CELLS))
    rank = odds(F.col("_u")) / odds(F.col("part"))
    return F.when(F.col("part") > 0, F.floor(rank / (1 + rank) * n_cells).cast("int"))


def plan(docs: DataFrame, max_repeat: float, weights: tuple[int, ...], seed: str) -> tuple[DataFrame, DataFrame]:
    """(classes, chosen): each class's certain copies, part and cut, and the (source, doc_id, size) taken in the cut cells."""
    d = saved(sized(docs.select("doc_id", "source", "text"), seed).drop("text"), "sizes").withColumn("class", digits(F.col("_size")))
    classes = saved(d.groupBy("source", "class").agg(F.sum("_size").alias("words"), F.count(F.lit(1)).alias("n")), "classes")
    totals = classes.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_docs"))
    t = class_copies(classes, source_targets(totals, max_repeat, weights), max_repeat)
    t = saved(t.withColumnsRenamed({"source": "_source", "class": "_class"}), "targets")
    d = d.join(t, F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class"))).withColumn("cell", cell()).where("cell is not null")
    cells = d.groupBy("_source", "cell").agg(F.sum("_size").alias("words"), F.first("left").alias("left"))
    up_to = Window.partitionBy("_source").orderBy("cell")
    cells = cells.withColumn("before", F.coalesce(F.sum("words").over(up_to.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = cells.where((F.col("before") + F.col("words") > F.col("left")) & (F.col("before") <= F.col("left")))
    # Cells without words can share the cut's place: the last is the one that is cut.
    cut = cut.groupBy("_source").agg(F.max(F.struct("cell", "before")).alias("x"))
    cut = saved(cut.select(F.col("_source").alias("_cut_source"), F.col("x.cell").alias("cut"), F.col("x.before").alias("before")), "cuts")
    inside = d.join(cut, F.col("_source").eqNullSafe(F.col("_cut_source")) & (F.col("cell") == F.col("cut")))
    inside = inside.withColumn("rank", odds(F.col("_u")) / odds(F.col("part")))
    order = Window.partitionBy("_source").orderBy("rank", "doc_id", "_size")
    inside = inside.withColumn("reach", F.col("before") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.withColumn("fits", F.col("reach") <= F.col("left"))
    missing = F.col("left") - F.coalesce(F.max(F.when(F.col("fits"), F.col("reach"))).over(Window.partitionBy("_source")), F.col("before"))
    inside = inside.withColumn("missing", missing)
    nearest = Window.partitionBy("_source", "fits").orderBy(F.abs(F.col("_size") - F.col("missing")), "rank", "doc_id", "_size")
    better = (F.row_number().over(nearest) == 1) & (F.abs(F.col("_size") - F.col("missing")) < F.col("missing"))
    inside = inside.withColumn("taken", F.col("fits") | better).where("taken")
    chosen = inside.select(F.col("_source").alias("_c_source"), F.col("doc_id").alias("_c_id"), F.col("_size").alias("_c_size"), F.lit(1).alias("_more")).distinct()
    taken = t.join(cut, F.col("_source").eqNullSafe(F.col("_cut_source")), "left").drop("_cut_source", "left", "before")
    return saved(taken, "copies"), saved(chosen, "chosen")


def with_copies(docs: DataFrame, max_repeat: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", broadcast_rows: int = 500_000) -> DataFrame:
    """(row, size, source_size, target, share, copies): each row of ``docs`` as a struct, and how often it is taken.

    ``share`` is the number of copies that the row should have, of which the whole ones are certain.
    No text is moved while the plan's tables have few rows. The sum of a source's taken words is
    as near its target as the last documents let it: where the cut falls inside a document, the
    one of the later documents in the cut's cell whose size is nearest to the words still missing
    is taken, if that comes nearer.

    Null texts have size 0 and no copies, as have other texts without words; null sources are a source
    of their own, last in order; null ids share one random number. Rows with equal ids get equal random numbers, and rows of equal id, source and
    size are decided alike, so of many such rows at the cut all are taken or none. A very long text is one row. An
    empty table gives none. Reruns agree whatever the partitions. Other columns pass through inside the struct, so no
    name can clash.
    """
    classes, chosen = plan(docs, max_repeat, weights, seed)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", "text")
    d = sized(own, seed).withColumn("class", digits(F.col("_size")))
    d = d.join(small(classes, broadcast_rows), F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class"))).withColumn("cell", cell())
    same = F.col("doc_id").eqNullSafe(F.col("_c_id")) & F.col("source").eqNullSafe(F.col("_c_source")) & (F.col("_size") == F.col("_c_size"))
    d = d.join(small(chosen, broadcast_rows), same & (F.col("cell") == F.col("cut")), "left")
    below = F.coalesce(F.when(F.col("cut").isNull(), F.col("cell").isNotNull()).otherwise(F.col("cell") < F.col("cut")), F.lit(False))
    copies = (F.col("whole") + below.cast("int") + F.coalesce("_more", F.lit(0))).cast("long")
    return d.select("row", F.col("_size").alias("size"), "source_size", "target", (F.col("whole") + F.col("part")).alias("share"), copies.alias("copies"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs``; taken is size times copies."""
    out = with_copies(docs.select("doc_id", "source", "text"), **options)
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it; columns as they are. Rows of no copies go.

    Nulls, empty texts, ties and repeated rows are as in ``with_copies``: rows without words go.
    """
    out = with_copies(docs, **options)
    return out.select("row", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))).select("row.*")


#: The query over documents in DuckDB.
DOCUMENTS_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5)
           / 281474976710656.0 AS u,
         row_number() OVER () AS r
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
f AS (SELECT *, source_size * CAST(3 AS DOUBLE) / weight AS full_at, source_size * CAST(3 AS DOUBLE) AS most FROM w),
v AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM f WINDOW b AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t0 AS (SELECT source, source_size, n_docs, least(weight * (SELECT max(level) FROM v WHERE level <= full_at), most) AS target FROM v),
k0 AS (SELECT source, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS class, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY ALL),
k1 AS (SELECT k0.*, source_size, n_docs, target, CAST(class * words AS DOUBLE) AS weight, words * CAST(3 AS DOUBLE) AS most
       FROM k0 JOIN t0 ON k0.source IS NOT DISTINCT FROM t0.source),
k2 AS (SELECT *, CASE WHEN weight > 0 THEN most / weight END AS full_at FROM k1),
k3 AS (SELECT *, sum(weight) OVER (PARTITION BY source) - coalesce(sum(weight) OVER b, 0) AS rest_weight, coalesce(sum(most) OVER b, 0) AS full_before
       FROM k2 WINDOW b AS (PARTITION BY source ORDER BY full_at NULLS LAST, class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k4 AS (SELECT *, CASE WHEN rest_weight > 0 THEN (target - full_before) / rest_weight END AS level FROM k3),
k5 AS (SELECT *, coalesce(least(class * max(CASE WHEN level <= full_at THEN level END) OVER (PARTITION BY source), 3), 0) AS copies FROM k4),
k6 AS (SELECT *, floor(copies + 1e-9) AS whole FROM k5),
t AS (SELECT source, class, source_size, n_docs, target, whole, CASE WHEN copies - whole > 1e-9 THEN copies - whole ELSE 0 END AS part,
             target - sum(whole * words) OVER (PARTITION BY source) AS missing0, least(ceil(n_docs / 2000.0), 65536) AS n_cells FROM k6),
j0 AS (SELECT d.doc_id, d.size, d.u, d.r, t.*, CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS rank
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source AND CASE WHEN d.size > 0 THEN length(bin(d.size)) ELSE 0 END = t.class),
j AS (SELECT *, CASE WHEN part > 0 THEN CAST(floor(rank / (1 + rank) * n_cells) AS INT) END AS cell FROM j0),
c0 AS (SELECT source, cell, CAST(sum(size) AS BIGINT) AS words, any_value(missing0) AS missing0 FROM j WHERE cell IS NOT NULL GROUP BY ALL),
c AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c0),
x AS (SELECT source, max(cell) AS cut, arg_max(before, cell) AS before FROM c WHERE before + words > missing0 AND before <= missing0 GROUP BY source),
m AS (SELECT j.*, x.cut, x.before FROM j LEFT JOIN x ON j.source IS NOT DISTINCT FROM x.source),
i0 AS (SELECT *, before + sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS reach FROM m WHERE cell = cut),
i1 AS (SELECT *, reach <= missing0 AS fits FROM i0),
i2 AS (SELECT *, missing0 - coalesce(max(CASE WHEN fits THEN reach END) OVER (PARTITION BY source), before) AS missing FROM i1),
i AS (SELECT *, CASE WHEN fits THEN 1 WHEN row_number() OVER (PARTITION BY source, fits ORDER BY abs(size - missing), rank, doc_id, size) = 1
                      AND abs(size - missing) < missing THEN 1 ELSE 0 END AS more FROM i2),
o AS (SELECT doc_id, size, source_size, target, CAST(whole AS BIGINT) + more AS copies FROM i
      UNION ALL
      SELECT doc_id, size, source_size, target,
             CAST(whole AS BIGINT) + CASE WHEN cell < cut OR (cell IS NOT NULL AND cut IS NULL) THEN 1 ELSE 0 END
      FROM m WHERE NOT coalesce(cell = cut, FALSE))
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(size * copies AS BIGINT) AS taken FROM o
"""
