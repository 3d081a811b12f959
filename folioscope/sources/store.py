"""The document store: pages by URL, in versions, as a Spark data source that is read and written.

A store is a folder of Parquet files and manifests. A manifest is a version: the files of each bucket of URLs, oldest
first; the newest row of a URL counts. Writing adds files and then one manifest, so a write that fails or is
taken back leaves the version before it as it was, and two writers cannot both make the same version. Reading
takes a bucket's files newest first, so rows of one URL meet in one task without a shuffle.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from folioscope.operators.crawl import COLUMNS, STATE
from folioscope.operators.stats import first_of
from folioscope.sources.shared import arrow_schema, filesystem, listed, put

BUCKETS = 64


@dataclass
class Manifest:
    """A version of a store: its bucket count, and (path, bucket, rows) of its files, oldest first."""

    version: int = 0
    buckets: int = BUCKETS
    files: list[list] = field(default_factory=list)


def versions(path: str) -> list[int]:
    files, root = filesystem(path)
    return [int(x.base_name.removesuffix(".json")) for x in listed(files, f"{root}/versions", ".json")]


def manifest(path: str, version: int | None = None) -> Manifest:
    """A version of the store at ``path``, the last one if none is named; version 0 is the empty store."""
    files, root = filesystem(path)
    if version is None:
        version = max(versions(path), default=0)
    if version == 0:
        return Manifest()
    with files.open_input_stream(f"{root}/versions/{version:012d}.json") as f:
        return Manifest(**json.loads(f.read()))


def bucket_of(url: str | None, buckets: int) -> int:
    return zlib.crc32((url or "").encode("utf-8", "surrogatepass")) % buckets


@dataclass
class Bucket(InputPartition):
    number: int
    files: list[str]


class StoreReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"]
        self.names = schema.fieldNames()
        kinds = dict(c.split() for c in STATE.split(", "))
        self.kinds = arrow_schema(", ".join(f"{c} {kinds[c]}" for c in self.names))
        version = options.get("version")
        self.manifest = manifest(self.path, None if version is None else int(version))
        self.url = options.get("url")

    def partitions(self) -> list[Bucket]:
        own: dict[int, list[str]] = {}
        for path, bucket, _ in self.manifest.files:
            own.setdefault(bucket, []).append(path)
        if self.url is not None:
            wanted = bucket_of(self.url, self.manifest.buckets)
            own = {b: f for b, f in own.items() if b == wanted}
        return [Bucket(b, f) for b, f in sorted(own.items())] or [Bucket(0, [])]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(self.path)
        seen: set[str | None] = set()
        for i, path in enumerate(reversed(partition.files)):
            with files.open_input_file(f"{root}/{path}") as f:
                for batch in pq.ParquetFile(f).iter_batches(1024, columns=[*dict.fromkeys(["url", *self.names])]):
                    urls = batch.column("url").to_pylist()
                    # Files hold a URL once, so only those of files read before can be newer.
                    fresh = [u not in seen for u in urls] if i else None
                    if i + 1 < len(partition.files):
                        seen.update(urls)
                    batch = batch.filter(pa.array(fresh)) if fresh else batch
                    batch = batch.filter(pa.compute.equal(batch.column("url"), self.url)) if self.url is not None else batch
                    if batch.num_rows:
                        # Files may differ in which columns they say are never null.
                        yield pa.RecordBatch.from_arrays([batch.column(c) for c in self.names], schema=self.kinds)


@dataclass
class Added(WriterCommitMessage):
    files: list[list]


class StoreWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        last = manifest(self.path)
        # A store keeps its buckets until it is written anew.
        asked = int(options.get("buckets", last.buckets))
        self.buckets = asked if overwrite or not last.version else last.buckets
        self.base = int(options.get("base", last.version))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Added:
        files, root = filesystem(self.path)
        files.create_dir(f"{root}/data", recursive=True)
        open_: dict[int, tuple[str, pq.ParquetWriter, list]] = {}
        try:
            for batch in iterator:
                buckets = pa.array([bucket_of(u, self.buckets) for u in batch.column("url").to_pylist()], pa.int32())
                for b in buckets.unique().to_pylist():
                    own = batch.filter(pa.compute.equal(buckets, b))
                    if b not in open_:
                        name = f"data/{b:05d}-{uuid.uuid4().hex}.parquet"
                        open_[b] = name, pq.ParquetWriter(files.open_output_stream(f"{root}/{name}"), own.schema, compression="zstd"), [0]
                    open_[b][1].write_batch(own)
                    open_[b][2][0] += own.num_rows
        except BaseException:
            for name, writer, _ in open_.values():
                writer.close()
                files.delete_file(f"{root}/{name}")
            raise
        for _, writer, _ in open_.values():
            writer.close()
        return Added([[name, b, rows[0]] for b, (name, _, rows) in open_.items()])

    def commit(self, messages: list[Added | None]) -> None:
        """The new version: the files there are, unless they are written over, and those of the tasks."""
        files, root = filesystem(self.path)
        files.create_dir(f"{root}/versions", recursive=True)
        last = manifest(self.path)
        if last.version != self.base:
            raise RuntimeError(f"the store is at version {last.version}; this write began at {self.base}")
        new = Manifest(self.base + 1, self.buckets, ([] if self.overwrite else last.files) + [f for m in messages if m for f in m.files])
        put(files, f"{root}/versions/{new.version:012d}.json", json.dumps(new.__dict__).encode())

    def abort(self, messages: list[Added | None]) -> None:
        files, root = filesystem(self.path)
        for name in [f[0] for m in messages if m for f in m.files]:
            if files.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound:
                files.delete_file(f"{root}/{name}")


class PageStore(DataSource):
    """``spark.read.format("page_store").load(folder)``: the pages of a store by URL; ``mode("append")`` puts rows in place of those of their URL, ``overwrite`` writes it anew.

    Options: version (to read), columns (to read, with commas between), url (one page, which is in one bucket), buckets (of a store that is written anew), base (the version that a write stands on).
    Rows of one URL belong to one task and a write has a URL once; ``upsert`` sees to both.
    """

    @classmethod
    def name(cls) -> str:
        return "page_store"

    def schema(self) -> str:
        kinds = dict(c.split() for c in STATE.split(", "))
        names = [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else COLUMNS
        return ", ".join(f"{c} {kinds[c]}" for c in names)

    def reader(self, schema: StructType) -> StoreReader:
        return StoreReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> StoreWriter:
        return StoreWriter(dict(self.options), schema, overwrite)


def read_store(spark: SparkSession, path: str, version: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """The state rows of a store, or some columns of them; an empty or missing store has none."""
    spark.dataSource.register(PageStore)
    options = ({"version": version} if version is not None else {}) | ({"columns": ",".join(columns)} if columns else {})
    return spark.read.format("page_store").options(**options).load(path)


def lookup(spark: SparkSession, path: str, url: str) -> DataFrame:
    """The row of one URL, from its bucket alone."""
    spark.dataSource.register(PageStore)
    return spark.read.format("page_store").option("url", url).load(path)


def upsert(rows: DataFrame, path: str, overwrite: bool = False, buckets: int | None = None, base: int | None = None) -> int:
    """Puts state rows in place of those of their URL, as one new version, whose number is returned; of several rows of a URL the latest fetched counts.

    ``base`` is the version that ``rows`` were made from: if another has come since, nothing is written.
    """
    spark = rows.sparkSession
    spark.dataSource.register(PageStore)
    last = manifest(path)
    n = buckets or last.buckets
    one = first_of(rows.select(COLUMNS), ["url"], [F.desc_nulls_last("fetched_at"), F.col("status"), F.col("content_hash"), F.col("html")])
    bucket = F.crc32(F.coalesce("url", F.lit("")).cast("binary")) % n
    stood = last.version if base is None else base
    one.repartition(min(n, 4 * spark.sparkContext.defaultParallelism), bucket).write.format("page_store").mode("overwrite" if overwrite else "append").options(buckets=n, base=stood).save(path)
    return stood + 1


def compact(spark: SparkSession, path: str, buckets: int | None = None) -> int:
    """Writes the store anew with one file a bucket; older versions stay until their files are removed."""
    now = manifest(path)
    return upsert(read_store(spark, path, now.version), path, overwrite=True, buckets=buckets or now.buckets, base=now.version)
