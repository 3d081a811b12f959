"""A paginated web API as Spark sources: category members and plain texts.

``CategoryMembers`` and ``PageTexts`` are data sources over lists of categories and pages, in batches and as
streams: partitions are byte ranges of the list's files, and a stream's offset is the last file it has read, so a
stream that is started again goes on behind it. ``category_members`` and ``page_texts`` read for the rows of a frame.
The continuation loop of a category runs inside its task. Requests go through a function from (url,
parameters) to decoded JSON, which a subclass or an argument replaces.
"""

from __future__ import annotations

import contextlib
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader
from pyspark.sql.types import StructType

from folioscope.sources.files import CORPUS
from folioscope.sources.shared import LineRange, arrow_schema, filesystem, line_ranges, listed, records_of

Fetch = Callable[[str, dict], dict]
MEMBERS = "source string, parent string, ns int, child string, pageid long"
#: A page's text, and what came of asking for it: kept, short (or not there), or failed.
OUTCOMES = f"{CORPUS}, outcome string"
KEPT, SHORT, FAIL = "kept", "short", "failed"
AGENT = "folioscope/1 (corpus builder)"


def fetch_json(url: str, parameters: dict, timeout: float = 20.0) -> dict:
    request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(parameters)}", headers={"User-Agent": AGENT})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


#: What a request may raise: no answer, or one that is no JSON.
FAILED = (OSError, ValueError)


def members(api_url: str, category: str, fetch: Fetch) -> Iterator[dict]:
    """The pages and sub-categories of one category, over all continuations."""
    more: dict = {}
    while True:
        answer = fetch(api_url, {"action": "query", "list": "categorymembers", "cmtitle": category, "cmtype": "page|subcat", "cmlimit": "500", "format": "json"} | more)
        yield from answer.get("query", {}).get("categorymembers", [])
        more = answer.get("continue", {})
        if not more:
            return


def category_members(categories: DataFrame, fetch: Fetch = fetch_json, delay: float = 0.1) -> DataFrame:
    """``MEMBERS`` of (source, api_url, category); of a category that fails, those read before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found: list[dict] = []
                with contextlib.suppress(*FAILED):
                    for m in members(row["api_url"], row["category"], fetch):
                        found.append(m)
                time.sleep(delay)
                rows = [(row["source"], row["category"], m.get("ns"), m.get("title", ""), m.get("pageid")) for m in found]
                kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in MEMBERS.split(", ")])

    return categories.select("source", "api_url", "category").mapInArrow(run, MEMBERS)


def ask_page(api_url: str, page: dict, least: int, fetch: Fetch) -> dict:
    """A row of ``OUTCOMES`` for one page (pageid, title, lang, source); the answer's title stands for the list's."""
    row = {c: page.get(c) for c in ("pageid", "title", "lang", "source")} | {"text": None, "outcome": FAIL}
    try:
        answer = fetch(api_url, {"action": "query", "prop": "extracts", "explaintext": 1, "pageids": page["pageid"], "format": "json"})
        found = answer.get("query", {}).get("pages", {}).get(str(page["pageid"]), {})
    except FAILED:
        return row
    text = found.get("extract") or ""
    if len(text) < least:
        return row | {"outcome": SHORT}
    return row | {"title": found.get("title") or row["title"], "text": text, "outcome": KEPT}


def in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 100) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows, so that what is slow to come goes on early."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def page_outcomes(pages: DataFrame, apis: DataFrame, least: int = 300, fetch: Fetch = fetch_json, delay: float = 0.05) -> DataFrame:
    """``OUTCOMES`` of pages (pageid, title, lang, source), a row each; pages of unknown sources are left out.

    ``apis`` is (source, api_url), a row for each site. A task waits ``delay`` seconds after each request, also after one that fails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for page in batch.to_pylist():
                    yield ask_page(page["api_url"], page, least, fetch)
                    time.sleep(delay)

        yield from in_batches(rows(), arrow_schema(OUTCOMES))

    none = {c: F.lit(None).cast("string") for c in ("title", "lang") if c not in pages.columns}
    known = pages.withColumns(none).join(apis, "source").select("pageid", "title", "lang", "source", "api_url")
    return known.mapInArrow(run, OUTCOMES)


def page_texts(pages: DataFrame, apis: DataFrame, least: int = 300, fetch: Fetch = fetch_json, delay: float = 0.05) -> DataFrame:
    """The records of ``page_outcomes`` with ``least`` characters or more; pages that fail have none."""
    return page_outcomes(pages, apis, least, fetch, delay).where(F.col("outcome") == KEPT).drop("outcome")


class ListReader(DataSourceReader):
    """Reads what ``rows`` makes of each record of the list at option path."""

    def __init__(self, source: ListSource):
        self.path = source.options["path"]
        self.step = int(source.options.get("rangebytes", 1 << 20))
        self.rows = source.rows_of()
        self.kinds = arrow_schema(source.schema())

    def partitions(self) -> list[LineRange]:
        files, root = filesystem(self.path)
        return line_ranges(listed(files, root), self.step) or [LineRange("", 0, 0)]

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        if partition.path:
            files, _ = filesystem(self.path)
            yield from in_batches((row for record in records_of(files, partition) for row in self.rows(record)), self.kinds)


class ListStream(ListReader, DataSourceStreamReader):
    """The same for files as they are added to the folder: each whole, and in order of their names."""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        files, root = filesystem(self.path)
        return {"after": max((x.path for x in listed(files, root)), default="")}

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        files, root = filesystem(self.path)
        return line_ranges([x for x in listed(files, root) if start["after"] < x.path <= end["after"]], self.step)


class ListSource(DataSource):
    """A source over a list of JSON records. Options: path, rangeBytes of the list for a partition, delay after a request."""

    fetch: Fetch = staticmethod(fetch_json)

    def rows_of(self) -> Callable[[dict], Iterator[dict]]:
        raise NotImplementedError

    def reader(self, schema: StructType) -> ListReader:
        return ListReader(self)

    def streamReader(self, schema: StructType) -> ListStream:
        return ListStream(self)


class CategoryMembers(ListSource):
    """``spark.read.format("category_members").load(list)``: ``MEMBERS`` of each record (source, api_url, category)."""

    @classmethod
    def name(cls) -> str:
        return "category_members"

    def schema(self) -> str:
        return MEMBERS

    def rows_of(self) -> Callable[[dict], Iterator[dict]]:
        fetch, delay = type(self).fetch, float(self.options.get("delay", 0.1))

        def rows(record: dict) -> Iterator[dict]:
            with contextlib.suppress(*FAILED):
                for m in members(record["api_url"], record["category"], fetch):
                    yield {"source": record["source"], "parent": record["category"], "ns": m.get("ns"), "child": m.get("title", ""), "pageid": m.get("pageid")}
            time.sleep(delay)

        return rows


class PageTexts(ListSource):
    """``spark.read.format("page_texts").option("apis", json).load(list)``: ``OUTCOMES`` of each page of a list (pageid, title, lang, source).

    Option apis is a JSON object of API addresses by source, least the fewest characters to keep.
    """

    @classmethod
    def name(cls) -> str:
        return "page_texts"

    def schema(self) -> str:
        return OUTCOMES

    def rows_of(self) -> Callable[[dict], Iterator[dict]]:
        fetch, delay = type(self).fetch, float(self.options.get("delay", 0.05))
        apis, least = json.loads(self.options["apis"]), int(self.options.get("least", 300))

        def rows(page: dict) -> Iterator[dict]:
            if page.get("source") in apis and page.get("pageid") is not None:
                yield ask_page(apis[page["source"]], page, least, fetch)
                time.sleep(delay)

        return rows
