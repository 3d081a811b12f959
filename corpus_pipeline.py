"""From raw documents to encoded training data, in five stages.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before it kept. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.common import read, saved
from folioscope.llm.encode import sentencepiece_encode
from folioscope.llm.line_dedup import document_line_dedup
from folioscope.llm.mixing import mixed
from folioscope.llm.near_dedup import near_dedup
from folioscope.llm.toxicity import without_toxic


#: The largest batch of rows that a Python worker is given, in bytes: its memory stays small beside the executor's heap.
BATCH = "2m"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ``BATCH`` and leaves them so, as stages are computed after they return; results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity detector rejects.

    Null and empty texts have no terms and are scored as such, rows without an id are scored as others,
    repeated rows alike. Columns pass through as they are. Without labels all stay; an empty table gives none.
    """
    small_batches(spark)
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that are on more than a fifth of their source's documents; no document goes.

    A null text becomes empty, and so does one of boilerplate alone; null sources are one source. Exact and near copies
    count as one document, a line repeated in a document once. Other columns but n_chars stay.
    """
    return document_line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of smallest id, of each group of near duplicates.

    Texts without words and rows without an id are in no group and stay. Rows that repeat a kept id stay
    with it, of equal texts with different ids the smallest id stays.
    """
    small_batches(spark)
    return near_dedup(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents up to its target; a document taken n times is n rows.

    Texts without words are not taken; null sources are a source of their own. Rows of equal id, source and size are
    decided alike. Columns stay as they are; an empty table gives none.
    """
    return mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, with doc_id; a null or empty text has none, and repeated rows have a row each."""
    small_batches(spark)
    return sentencepiece_encode(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("source mix", source_mix),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the learned detector nor the encoder; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written and read again for the next."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, saved(docs, f"stage-{i}") if i else docs, sf_dir)
    return docs
