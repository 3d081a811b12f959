"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.storage import saved, spread, work_dir

__all__ = ["held_out", "read", "saved", "small", "tidied", "training_rows", "training_texts", "work_dir"]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one in fewer splits than there are cores is dealt out to them."""
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text is a multiple of 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled rows that are not held out, as (doc_id, y).

    The rows are those with the smallest hash of their id, so reruns agree. Rows without an
    id or label do not count; several labels of one document become their largest.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )


def training_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, y, text) for the ids of ``rows`` (doc_id, y) that ``docs`` has, which are bounded and broadcast.

    Of several texts of an id the one of smallest hash counts, so there are no more rows than ids.
    """
    met = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    return met.groupBy("doc_id").agg(F.min("y").alias("y"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def small(df: DataFrame, limit: int) -> DataFrame:
    """``df``, a written table, marked for broadcast if it has at most ``limit`` rows; else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidied(run: Batches) -> Batches:
    """``run`` for mapInArrow, with what its tables took given back when it ends: Spark keeps Python workers for later tasks, and they what they once held."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return own
