"""From documents to the numbered lines that are indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import is_blank, one_line, title_bytes
from folioscope.operators.numbering import dense_ids


def prepare_corpus(docs: DataFrame) -> DataFrame:
    """(doc_id, line) of documents with a text: one line each."""
    return docs.where("text is not null and text <> ''").select("doc_id", one_line(F.col("text")).alias("line"))


def corpus_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line) without carriage returns and without blank lines; doc_id is the source's key."""
    return lines.where(~is_blank(F.col("line"))).select("doc_id", F.replace("line", F.lit("\r"), F.lit("")).alias("line"))


def line_order(tie: Column) -> list[Column]:
    """The order in which lines are numbered: by their source's key, null last, and of one key by ``tie``."""
    return [F.col("doc_id").asc_nulls_last(), tie]


def numbered_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line, docid), written once: 1, 2, ... over the lines in order of their source's key.

    Lines of one key, or without one, have numbers of their own, in order of the line's hash.
    """
    return dense_ids(lines.select("doc_id", "line"), line_order(F.xxhash64("line")), "docid")


def docs_table(numbered: DataFrame) -> DataFrame:
    """(docid, title, url) of numbered lines: the title cut from the line, as bytes, and an empty URL."""
    return numbered.select("docid", title_bytes(F.col("line"), F.col("docid")).alias("title"), F.lit("").alias("url"))


def min_text(docs: DataFrame, least: int = 300) -> DataFrame:
    """Documents of ``least`` characters or more."""
    return docs.where(F.length("text") >= least)
