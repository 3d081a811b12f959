"""The positional inverted index as tables: postings, vocab, docs.

A line is one row, so its tokens are grouped by term inside its task and no token is moved before that.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.text import SEARCH, Tokenizer, vbyte_length
from folioscope.operators.corpus import docs_table, line_order, numbered_lines
from folioscope.operators.numbering import cells_before, dense_ids, running_sum
from folioscope.operators.slices import count_rows, gap_rows, place_rows, postings_rows, size_rows, stem_rows
from folioscope.storage import saved

#: Docids of a cell, in bits: what one task has of a term's list at most.
CELL_BITS = 16


def tokens(lines: DataFrame, tokenizer: Tokenizer = SEARCH) -> DataFrame:
    """(docid, pos, term): every token of every numbered line with its place, from 0."""
    return lines.select("docid", F.posexplode(tokenizer.tokens(F.col("line"))).alias("pos", "term"))


def token_stems(lines: DataFrame, tokenizer: Tokenizer = SEARCH) -> DataFrame:
    """(docid, pos, stem): the stem of every token of numbered lines, in place of its term."""
    return cut(lines, tokenizer).mapInArrow(stem_rows, "docid long, pos int, stem string")


def postings(lines: DataFrame, tokenizer: Tokenizer = SEARCH) -> DataFrame:
    """(term, docid, tf, positions) of numbered lines: one row for each term of each, positions ascending.

    A task's lines are grouped as arrays, some at a time, and come out in order of term and docid; nothing is shuffled.
    """
    return cut(lines, tokenizer).mapInArrow(postings_rows, "term string, docid long, tf long, positions array<int>")


def counts(lines: DataFrame, tokenizer: Tokenizer = SEARCH) -> DataFrame:
    """(term, docid, tf) of numbered lines."""
    return cut(lines, tokenizer).mapInArrow(count_rows, "term string, docid long, tf long")


def cut(lines: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(docid, tokens) of numbered lines, as ``operators/slices.py`` takes them."""
    return lines.select(F.col("docid").cast("long").alias("docid"), tokenizer.tokens(F.col("line")).alias("tokens"))


def lexicon(lines: DataFrame, terms: list[str] | None = None, tokenizer: Tokenizer = SEARCH) -> DataFrame:
    """(term, df) of lines (line), of ``terms`` alone if given: others are dropped before they leave their row."""
    found = tokenizer.tokens(F.col("line"))
    if terms is not None:
        found = F.filter(found, lambda t: t.isin(terms) if terms else F.lit(False))
    return vocab(lines.select(F.explode(F.array_distinct(found)).alias("term")))


def vocab(by_doc: DataFrame) -> DataFrame:
    """(term, df) of one row for each term of each document."""
    return by_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def with_previous(by_doc: DataFrame) -> DataFrame:
    """``by_doc`` (term, docid, ...) with previous: the docid before it in the term's list, for the first 0.

    Lists are cut in cells of docids, and each cell is told the last docid of the cells before it. ``by_doc`` is read
    twice, so it should be a written table.
    """
    rows = by_doc.withColumn("_cell", F.shiftright("docid", CELL_BITS))
    inside = F.lag("docid").over(Window.partitionBy("term", "_cell").orderBy("docid"))
    earlier = cells_before(rows.select("term", "_cell", "docid"), ["term"], "_cell", F.col("docid"), "max")
    joined = rows.withColumn("_inside", inside).join(earlier, ["term", "_cell"], "left")
    return joined.select(*by_doc.columns, F.coalesce("_inside", "_earlier", F.lit(0)).alias("previous"))


def posting_gaps(by_doc: DataFrame) -> DataFrame:
    """(term, docid, gap): docid less the one before it in the term's list, the first less 0."""
    return with_previous(by_doc).select("term", "docid", (F.col("docid") - F.col("previous")).alias("gap"))


def line_gaps(lines: DataFrame, tokenizer: Tokenizer = SEARCH) -> DataFrame:
    """``posting_gaps`` straight from numbered lines, whose docids are unique.

    Gaps are taken inside slices of consecutive docids. Only a term's first row of each slice looks for the slice before it,
    so what is shuffled is a row for each term of each slice.
    """
    rows = saved(cut(lines, tokenizer).mapInArrow(gap_rows, "term string, docid long, gap long, last long"), "gaps")
    before = F.lag("last").over(Window.partitionBy("term").orderBy("docid"))
    first = rows.where("gap is null").select("term", "docid", (F.col("docid") - F.coalesce(before, F.lit(0))).alias("gap"))
    return rows.where("gap is not null").select("term", "docid", "gap").unionByName(first)


def gaps_to_docids(gaps: DataFrame) -> DataFrame:
    """(term, docid) back from (term, docid, gap), by sums of gaps alone; docid tells order and cell."""
    rows = gaps.withColumn("_cell", F.shiftright("docid", CELL_BITS))
    up_to = Window.partitionBy("term", "_cell").orderBy("docid").rowsBetween(Window.unboundedPreceding, 0)
    earlier = cells_before(rows.select("term", "_cell", "gap"), ["term"], "_cell", F.col("gap"), "sum")
    joined = rows.withColumn("_inside", F.sum("gap").over(up_to)).join(earlier, ["term", "_cell"], "left")
    return joined.select("term", (F.col("_inside") + F.coalesce("_earlier", F.lit(0))).alias("docid"))


def position_gaps(post: DataFrame) -> DataFrame:
    """(term, docid, pos, gap) from positions in order, inside each row's array."""
    gap = F.transform("positions", lambda p, i: F.struct(p.cast("long").alias("pos"), (p - F.when(i > 0, F.get("positions", i - 1)).otherwise(0)).cast("long").alias("gap")))
    return post.select("term", "docid", F.explode(gap).alias("x")).select("term", "docid", "x.pos", "x.gap")


def line_position_gaps(lines: DataFrame, tokenizer: Tokenizer = SEARCH) -> DataFrame:
    """``position_gaps`` straight from numbered lines, without the arrays between."""
    return cut(lines, tokenizer).mapInArrow(place_rows, "term string, docid long, pos long, gap long")


def vocab_offsets(post: DataFrame) -> DataFrame:
    """(term, df, bytes, offset): the size of each term's list with variable-byte gaps, and where it begins in byte order.

    Positions become a size inside their row, and only that is kept of them. Gaps are sized inside cells of docids, which end as a row
    each; the gap into a cell is sized there.
    """
    gaps = F.transform("positions", lambda p, i: vbyte_length(p - F.when(i > 0, F.get("positions", i - 1)).otherwise(0)))
    several = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    inside = F.when(F.size("positions") == 1, vbyte_length(F.col("positions")[0])).otherwise(several)
    rows = post.select("term", "docid", F.shiftright("docid", CELL_BITS).alias("_cell"), (vbyte_length(F.col("tf")) + inside).alias("b"))
    gap = F.col("docid") - F.lag("docid").over(Window.partitionBy("term", "_cell").orderBy("docid"))
    sized = rows.withColumn("b", F.col("b") + F.when(gap.isNull(), F.lit(0)).otherwise(vbyte_length(gap)))
    cells = sized.groupBy("term", "_cell").agg(
        F.count(F.lit(1)).alias("df"), F.sum("b").alias("b"), F.min("docid").alias("first"), F.max("docid").alias("last")
    )
    into = F.col("first") - F.coalesce(F.lag("last").over(Window.partitionBy("term").orderBy("_cell")), F.lit(0))
    terms = cells.withColumn("b", F.col("b") + vbyte_length(into)).groupBy("term").agg(F.sum("df").alias("df"), F.sum("b").alias("b"))
    terms = saved(terms.select("term", "df", (F.col("b") + vbyte_length(F.col("df"))).alias("bytes")), "term-sizes")
    return running_sum(terms, F.col("bytes"), [F.col("term")], "offset")


def line_offsets(lines: DataFrame, tokenizer: Tokenizer = SEARCH) -> DataFrame:
    """``vocab_offsets`` straight from numbered lines, whose docids are unique: lists are sized inside slices of consecutive docids, which end as a row
    for each of their terms; the gap into a slice is sized here."""
    parts = cut(lines, tokenizer).mapInArrow(size_rows, "term string, df long, b long, first long, last long")
    into = F.col("first") - F.coalesce(F.lag("last").over(Window.partitionBy("term").orderBy("first")), F.lit(0))
    terms = parts.withColumn("b", F.col("b") + vbyte_length(into)).groupBy("term").agg(F.sum("df").alias("df"), F.sum("b").alias("b"))
    terms = saved(terms.select("term", "df", (F.col("b") + vbyte_length(F.col("df"))).alias("bytes")), "term-sizes")
    return running_sum(terms, F.col("bytes"), [F.col("term")], "offset")


#: A part's number in the name of a file that Spark has written.
PART = r"^part-(\d+)"


def of_parts(table: DataFrame, parts: set[int]) -> DataFrame:
    """A written table's parts of these numbers, by their files' names; the others are not opened."""
    files = [f for f in table.inputFiles() if (found := re.match(PART, f.rpartition("/")[2])) and int(found[1]) in parts]
    reader = table.sparkSession.read.schema(table.schema)
    return reader.parquet(*files) if files else table.sparkSession.createDataFrame([], table.schema)


@dataclass
class Index:
    """An index: ``postings`` (term, docid, tf, ...), ``vocab`` (term, df), ``docs`` (docid, ...)."""

    postings: DataFrame
    vocab: DataFrame
    docs: DataFrame

    @classmethod
    def build(cls, lines: DataFrame, tokenizer: Tokenizer = SEARCH) -> Index:
        """The index of lines (doc_id, line), which are numbered and written once, and whose tokens are cut once."""
        numbered = numbered_lines(lines)
        post = saved(postings(numbered, tokenizer), "postings")
        return cls(post, vocab(post), docs_table(numbered))

    def write(self, path: str) -> None:
        """Parquet tables under ``path``: postings by ranges of (term, docid), so that a common term is many files'; the lexicon says in which parts.

        ``vocab`` has (term, df, first, last): the numbers of the first and last part with the term's postings. ``ranges`` has (part, low, high): the
        terms of each of the lexicon's parts, a row a file.
        """
        spark, order = self.postings.sparkSession, ["term", "docid"]
        self.postings.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/postings")
        part = F.regexp_extract("_metadata.file_name", PART, 1).cast("int")
        written = spark.read.parquet(f"{path}/postings").select("term", part.alias("part"))
        lexicon_ = written.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.min("part").alias("first"), F.max("part").alias("last"))
        lexicon_.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/vocab")
        terms = spark.read.parquet(f"{path}/vocab").select("term", part.alias("part")).groupBy("part").agg(F.min("term").alias("low"), F.max("term").alias("high"))
        terms.coalesce(1).write.mode("overwrite").json(f"{path}/ranges")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "vocab", "docs")))

    @classmethod
    def read_terms(cls, spark: SparkSession, path: str, terms: list[str]) -> Index:
        """The written index as a query of ``terms`` needs it: of the lexicon the parts whose range holds a term, of the postings those that the lexicon names.

        No other file is opened, and none of the postings for terms that are not there. What comes to the driver is a row for each
        of the lexicon's parts, and one for each term.
        """
        whole = cls.read(spark, path)
        ranges = spark.read.schema("part int, low string, high string").json(f"{path}/ranges")
        held = F.exists(F.array(*map(F.lit, terms)), lambda t: (F.col("low") <= t) & (t <= F.col("high"))) if terms else F.lit(False)
        parts = {r.part for r in ranges.where(held).collect()}
        lexicon_ = of_parts(whole.vocab, parts).where(F.col("term").isin(terms) if terms else F.lit(False))
        rows = lexicon_.collect()
        own = spark.createDataFrame(rows, whole.vocab.schema)
        return cls(of_parts(whole.postings, {p for r in rows for p in range(r["first"], r["last"] + 1)}), own, whole.docs)

    @classmethod
    def of_terms(cls, lines: DataFrame, terms: list[str], tokenizer: Tokenizer = SEARCH) -> Index:
        """What a query of ``terms`` needs, straight from lines (doc_id, line): of each line, how often it has each term.

        Texts are read once; the counts are written, numbered as ``numbered_lines`` does, and no other term leaves its row.
        """
        own = F.filter(tokenizer.tokens(F.col("line")), lambda t: t.isin(terms) if terms else F.lit(False))
        found = lines.select("doc_id", F.xxhash64("line").alias("tie"), own.alias("own"))

        def times(term: str) -> Column:
            return F.struct(F.lit(term).alias("term"), F.size(F.filter("own", lambda x: x == term)).cast("long").alias("tf"))

        every = F.array(*map(times, terms)) if terms else F.array().cast("array<struct<term:string,tf:bigint>>")
        some = F.filter(every, lambda x: x["tf"] > 0)
        numbered = dense_ids(saved(found.select("doc_id", "tie", some.alias("found")), "found"), line_order(F.col("tie")), "docid")
        post = numbered.select("docid", F.explode("found").alias("x")).select("x.term", "docid", "x.tf")
        return cls(post, vocab(post), numbered.select("docid"))
