"""A download of page texts that goes on where it stopped.

What is settled is left out before anything is fetched. The sink's tasks fetch pages and write records as rolling files of
JSON lines, and after each file a progress file that names it and says what came of every page in it; a page
that has its entry is not asked for again, neither by a later run nor by a task that takes the place of a lost one. So a
download that is cut off costs at most the pages since a task's last file.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from folioscope.sources.files import CORPUS
from folioscope.sources.shared import filesystem, listed, put
from folioscope.sources.wiki import FAIL, KEPT, SHORT, Fetch, ask_page, fetch_json

ASKED = "pageid long, title string, lang string, source string, api_url string"
PROGRESS = "source string, pageid long, outcome string, file string"
RECORD = [c.split()[0] for c in CORPUS.split(", ")]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    counts: dict[str, int]


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, fetch: Fetch):
        self.path, self.run, self.fetch = options["path"], uuid.uuid4().hex, fetch
        self.least, self.delay = int(options.get("least", 300)), float(options.get("delay", 0.05))
        self.per_file, self.seconds = int(options.get("perfile", 20_000)), float(options.get("seconds", 60))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = filesystem(self.path)
        for folder in ("batches", "progress"):
            files.create_dir(f"{root}/{folder}", recursive=True)
        stem = f"batch-{self.run}-{TaskContext.get().partitionId():06d}-"
        done = Written([], {KEPT: 0, SHORT: 0, FAIL: 0})
        settled = set()
        # What a lost attempt of this task had written stands.
        for x in listed(files, f"{root}/progress"):
            if x.base_name.startswith(stem):
                with files.open_input_stream(x.path) as f:
                    rows = [json.loads(line) for line in f.read().splitlines()]
                settled |= {(row["source"], row["pageid"]) for row in rows}
                self.count(done, x.base_name, rows)
        held: list[dict] = []
        records, began = 0, time.monotonic()

        def flush() -> None:
            name = f"{stem}{len(done.files):06d}.jsonl"
            text = lambda rows: "".join(json.dumps(row, ensure_ascii=False) + "\n" for row in rows).encode("utf-8", "surrogatepass")
            put(files, f"{root}/batches/{name}", text({c: row[c] for c in RECORD} for row in held if row["outcome"] == KEPT))
            put(files, f"{root}/progress/{name}", text({"source": row["source"], "pageid": row["pageid"], "outcome": row["outcome"], "file": name} for row in held))
            self.count(done, name, held)
            held.clear()

        for batch in iterator:
            for page in batch.to_pylist():
                if (page["source"], page["pageid"]) in settled:
                    continue
                held.append(ask_page(page["api_url"], page, self.least, self.fetch))
                records += held[-1]["outcome"] == KEPT
                if records >= self.per_file or time.monotonic() - began >= self.seconds:
                    flush()
                    records, began = 0, time.monotonic()
                time.sleep(self.delay)
        if held:
            flush()
        return done

    @staticmethod
    def count(done: Written, name: str, rows: list[dict]) -> None:
        done.files.append(name)
        for row in rows:
            done.counts[row["outcome"]] += 1

    def commit(self, messages: list[Written | None]) -> None:
        """Adds what the run came to; the tasks' files count already."""
        files, root = filesystem(self.path)
        files.create_dir(f"{root}/runs", recursive=True)
        total = {k: sum(m.counts[k] for m in messages if m) for k in (KEPT, SHORT, FAIL)}
        put(files, f"{root}/runs/{self.run}.json", json.dumps(total | {"files": sum(len(m.files) for m in messages if m)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing is taken back: what has a progress file is whole and need not be fetched again."""


class CorpusDownload(DataSource):
    """``pages.write.format("corpus_download").mode("append").save(folder)``, for rows of ``ASKED``: fetches each page and keeps its record.

    Options: perFile (records of a file), seconds (after which a task writes what it has), least (characters of a text), delay (after a request).
    """

    fetch: Fetch = staticmethod(fetch_json)

    @classmethod
    def name(cls) -> str:
        return "corpus_download"

    def schema(self) -> str:
        return ASKED

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("records are only added")
        return BatchWriter(dict(self.options), type(self).fetch)


def lines_at(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a folder; none if it is not there."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """``PROGRESS``: what came of each page that was asked for; a page that failed at first may have several rows."""
    return lines_at(spark, f"{path}/progress", PROGRESS)


def remaining(pages: DataFrame, path: str, retry_failed: bool = True) -> DataFrame:
    """The rows of ``pages`` (source, pageid, ...) that are not settled under ``path``, each page once; failed ones are asked for again."""
    settled = progress(pages.sparkSession, path)
    settled = settled.where(F.col("outcome") != FAIL) if retry_failed else settled
    return pages.dropDuplicates(["source", "pageid"]).join(settled.select("source", "pageid"), ["source", "pageid"], "left_anti")


def download(
    pages: DataFrame, apis: DataFrame, path: str, least: int = 300, fetch: Fetch = fetch_json, delay: float = 0.05, per_file: int = 20_000, seconds: float = 60, tasks: int | None = None, retry_failed: bool = True
) -> None:
    """Fetches the texts of ``pages`` (pageid, title, lang, source) that ``path`` does not have and adds them to it.

    ``tasks`` bounds the requests at a time; pages without an id or of sources without an API are left out. A run that has nothing to do
    makes no request.
    """
    spark = pages.sparkSession
    spark.dataSource.register(type("Download", (CorpusDownload,), {"fetch": staticmethod(fetch)}))
    none = {c: F.lit(None).cast("string") for c in ("title", "lang") if c not in pages.columns}
    rest = remaining(pages.withColumns(none).where("pageid is not null"), path, retry_failed).join(apis, "source")
    rest = rest.select(*(c.split()[0] for c in ASKED.split(", "))).repartition(tasks or spark.sparkContext.defaultParallelism, "source", "pageid")
    rest.write.format("corpus_download").mode("append").options(perFile=per_file, seconds=seconds, least=least, delay=delay).save(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The records of a download: those of files that a progress file names, so pages of a file cut off before that do not stand twice."""
    named = progress(spark, path).select(F.col("file").alias("_file")).distinct()
    records = lines_at(spark, f"{path}/batches", CORPUS)
    if not records.inputFiles():
        return records
    return records.withColumn("_file", F.col("_metadata.file_name")).join(named, "_file", "left_semi").drop("_file")
