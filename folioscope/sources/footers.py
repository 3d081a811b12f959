"""What tables take in storage, by the footers of their Parquet files; no column is read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import human_size
from folioscope.sources.shared import arrow_schema, filesystem

FOOTERS = "name string, file string, n_rows long, row_groups long, file_bytes long, stored_bytes long, raw_bytes long"


def read_footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow on (name, file): rows of ``FOOTERS``; stored are compressed column chunks, raw the same before compression."""
    for batch in batches:
        rows = []
        for name, uri in zip(*(batch.column(i).to_pylist() for i in range(2))):
            files, path = filesystem(uri)
            with files.open_input_file(path) as f:
                own = pq.ParquetFile(f).metadata
                groups = [own.row_group(i) for i in range(own.num_row_groups)]
                stored = sum(g.column(c).total_compressed_size for g in groups for c in range(g.num_columns))
                rows.append((name, uri, own.num_rows, len(groups), f.size(), stored, sum(g.total_byte_size for g in groups)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], schema=arrow_schema(FOOTERS))


def footers(tables: dict[str, DataFrame]) -> DataFrame:
    """``FOOTERS`` of every file of tables that were read from Parquet; tasks read the footers, a file each at a time."""
    spark = next(iter(tables.values())).sparkSession
    files = [(name, f) for name, df in sorted(tables.items()) for f in df.inputFiles()]
    asked = spark.createDataFrame(files, "name string, file string")
    return asked.repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(read_footers, FOOTERS)


def storage_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, files, n_rows, row_groups, file_bytes, stored_bytes, raw_bytes, size) of each table that has files, size being the files' for reading."""
    sums = [F.sum(c).alias(c) for c in ("n_rows", "row_groups", "file_bytes", "stored_bytes", "raw_bytes")]
    return footers(tables).groupBy("name").agg(F.count(F.lit(1)).alias("files"), *sums).withColumn("size", human_size(F.col("file_bytes")))
