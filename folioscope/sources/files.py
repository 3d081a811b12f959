"""File sources and sinks: JSON records, line corpora, frequency tables, page lists."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.operators.numbering import dense_ids
from folioscope.sources.shared import filesystem
from folioscope.storage import saved

CORPUS = "pageid long, title string, lang string, source string, text string"
PAGES = "pageid long, title string, lang string, source string"


@dataclass(frozen=True)
class CrawlConfig:
    """The settings of a crawl."""

    delay_sec: float
    recrawl_interval_sec: int
    base_url: str
    source_name: str
    pages_list_path: str
    max_documents: int = 10**9


def crawl_config(settings: dict) -> CrawlConfig:
    """From nested settings with the sections logic and seeds; only page lists are known as seeds."""
    logic, seeds = settings["logic"], settings["seeds"]
    if seeds["type"] != "pages_list":
        raise ValueError(f"unknown seeds: {seeds['type']}")
    return CrawlConfig(
        float(logic["delay_sec"]), int(logic["recrawl_interval_sec"]), seeds["base_url"], seeds["source_name"], seeds["pages_list_path"], int(logic.get("max_documents", 10**9))
    )


def read_config(path: str) -> CrawlConfig:
    """The settings of a YAML file, or of JSON, which is YAML too; without a YAML reader only JSON is read."""
    files, own = filesystem(path)
    with files.open_input_stream(own) as f:
        text = f.read().decode()
    try:
        import yaml
    except ImportError:
        return crawl_config(json.loads(text))
    return crawl_config(yaml.safe_load(text))


def read_records(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """JSON lines with a text; lines that are no such records are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("text is not null and text <> ''")


def write_records(df: DataFrame, path: str, key: list[str], per_file: int = 20_000) -> None:
    """Adds the rows whose ``key`` is not at ``path`` yet, in files of ``per_file`` records."""
    try:
        df = df.join(df.sparkSession.read.schema(df.schema).json(path).select(*key), key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    df.write.option("maxRecordsPerFile", per_file).mode("append").json(path)


def read_pages_list(spark: SparkSession, path: str, array: bool = True) -> DataFrame:
    """The entries of a JSON array of pages, or of one JSON record a line, which can be split between tasks."""
    return spark.read.schema(PAGES).option("multiLine", array).json(path)


def write_pages_list(pages: DataFrame, path: str) -> None:
    """Page entries as JSON records, one a line."""
    pages.write.mode("overwrite").json(path)


def write_pages_array(pages: DataFrame, path: str) -> None:
    """Page entries as one JSON array in one file, in order of pageid: a record a line, written by one task as they come."""
    record = F.to_json(F.struct(*pages.columns), {"ignoreNullFields": "false"})
    ends = Window.orderBy("pageid")
    lines = pages.select("pageid", record.alias("x"), (F.lead("pageid", 1, -1).over(ends) == -1).alias("last"), (F.lag("pageid", 1, -1).over(ends) == -1).alias("first"))
    lines = lines.select("pageid", F.concat(F.when(F.col("first"), F.lit("[")).otherwise(F.lit(" ")), "x", F.when(F.col("last"), F.lit("]")).otherwise(F.lit(","))).alias("value"))
    lines.coalesce(1).sortWithinPartitions("pageid").select("value").write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of text files, ended by line feeds alone: a carriage return stays in its line."""
    return spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "line")


def read_token_lines(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_lines``, less one carriage return at the end of a line."""
    return read_lines(spark, path).withColumn("line", F.regexp_replace("line", "\r$", ""))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One line a row; the rows' order is that of the frame's partitions."""
    df.select(column).write.mode("overwrite").text(path)


def write_freqs(freqs: DataFrame, path: str) -> None:
    """term and count, tab between, largest first."""
    freqs.orderBy(F.desc("cnt"), "term").select("term", "cnt").write.mode("overwrite").option("sep", "\t").csv(path)


def parse_freqs(lines: DataFrame) -> DataFrame:
    """(term, cnt) of lines (line): two fields and a positive whole number, else the line does not count."""
    parts = F.split(F.regexp_replace("line", "[\r\n]+$", ""), "\t")
    cnt = F.expr("try_cast(trim(_parts[1]) as long)")
    return lines.withColumn("_parts", parts).where(F.size("_parts") == 2).select(F.col("_parts")[0].alias("term"), cnt.alias("cnt")).where("cnt > 0")


def numbered_file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line) of text files: 1, 2, ... in order of file name and place, over all splits."""
    lines = spark.read.option("lineSep", "\n").text(path)
    placed = lines.select(F.col("value").alias("line"), "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place"))
    order = [F.col("file_path"), F.col("file_block_start"), F.col("place")]
    return dense_ids(saved(placed, "file-lines"), order, "doc_id").select("doc_id", "line")


def read_freqs(spark: SparkSession, path: str, max_terms: int | None = None) -> DataFrame:
    """The table of a frequency file; ``max_terms`` counts its first lines, whether they hold a term or not."""
    if max_terms is None:
        return parse_freqs(read_lines(spark, path))
    return parse_freqs(numbered_file_lines(spark, path).where(F.col("doc_id") <= max_terms).select("line"))
