"""Line dedup by site-relative frequency, with DataFrame functions only.

For each host, the share of its pages that contain a line is counted. Lines on more than
``ratio`` of the host's pages, and on ``min_pages`` pages at least, are boilerplate and dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import saved, small
from folioscope.llm.near_dedup import near_components

#: Tags and line breaks end a line of a web page.
PAGE_BREAKS = r"<[^>]*>|[\r\n]"
BLANKS = " \t\x0b\x0c\r"


def page_lines(html: Column) -> Column:
    """The non-blank runs of text between tags and line breaks, trimmed; null gives none."""
    parts = F.split(F.coalesce(html, F.lit("")), PAGE_BREAKS)
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


def text_lines(text: Column) -> Column:
    """A text's lines as they are, blank ones included, so that joining them gives the text again."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def url_host(url: Column) -> Column:
    """Lower-case host of a URL; "" where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def line_hashes(lines: str) -> Column:
    """The hashes of a page's distinct lines that are not blank."""
    return F.array_distinct(F.transform(F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != ""), lambda x: F.xxhash64(x)))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int, copies_count_once: bool, page: Column | None = None) -> DataFrame:
    """(_host, _drop): the hashes of each host's boilerplate lines; ``pages`` has _host and _lines.

    A host has at most (mean distinct lines of its pages) / ``ratio`` such lines, which bounds
    the array. Lines are counted per page before they leave it, and partially before each
    shuffle, so neither a host with most pages nor a line on every page is gathered anywhere.
    With ``copies_count_once``, pages of equal lines, or of equal ``page`` if given, count as one
    page of the host.
    """
    page = F.xxhash64("_lines") if page is None else page
    keyed = pages.select("_host", line_hashes("_lines").alias("_hashes"), (page if copies_count_once else F.lit(0)).alias("_page"))
    n = F.count_distinct("_page") if copies_count_once else F.count(F.lit(1))
    lines = keyed.select("_host", "_page", F.explode("_hashes").alias("_line")).groupBy("_host", "_line").agg(n.alias("_pages"))
    totals = keyed.groupBy("_host").agg(n.alias("_total"))
    return (
        lines.where(F.col("_pages") >= min_pages)
        .join(totals, "_host")
        .where(F.col("_pages") > F.lit(ratio) * F.col("_total"))
        .groupBy("_host")
        .agg(F.collect_set("_line").alias("_drop"))
    )


def with_drop(own: DataFrame, bad: DataFrame, n_bad: int, broadcast_lines: int, salts: int) -> DataFrame:
    """``own``: _host, _lines and others, with the boilerplate ``_drop`` of its host, null for none."""
    if n_bad <= broadcast_lines:
        return own.join(F.broadcast(bad), "_host", "left")
    each = bad.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = own.withColumn("_salt", F.pmod(F.xxhash64("_lines"), F.lit(salts)).cast("int"))
    return dealt.join(each, ["_host", "_salt"], "left")


def with_near_copies(joined: DataFrame, broadcast_ids: int = 1_000_000) -> DataFrame:
    """(_host, _lines, _page) of the hosts that have boilerplate in ``joined``: rows as structs, _host, _lines and _drop.

    Pages that have such lines and are near copies, as the near-dedup stage tells them, have one
    _page. Other pages, and rows without an id, are told by their lines.
    """
    pages = joined.where("_drop is not null").select(F.col("row.doc_id").cast("long").alias("_id"), F.col("row.text").alias("_text"), "_host", "_lines", "_drop")
    some = pages.where(F.col("_id").isNotNull() & F.arrays_overlap(line_hashes("_lines"), "_drop"))
    groups = near_components(saved(some.select(F.col("_id").alias("doc_id"), F.col("_text").alias("text")), "frequent-lines"))
    groups = saved(groups.groupBy(F.col("doc_id").alias("_of")).agg(F.min("component_id").alias("_group")), "page-groups")
    grouped = pages.join(small(groups, broadcast_ids), F.col("_id") == F.col("_of"), "left")
    page = F.when(F.col("_group").isNull(), F.xxhash64("_lines")).otherwise(F.xxhash64(F.lit("group"), "_group"))
    return grouped.select("_host", "_lines", page.alias("_page"))


def line_dedup(
    df: DataFrame,
    host: Column,
    lines: Column,
    ratio: float = 0.2,
    min_pages: int = 3,
    copies_count_once: bool = False,
    near_copies_count_once: bool = False,
    broadcast_lines: int = 500_000,
    salts: int = 32,
) -> DataFrame:
    """(row, kept, n_lines, n_dropped): each row of ``df`` as a struct, and the lines it keeps.

    Null hosts form one host of their own. A null or empty text has the lines that ``lines``
    gives it; blank lines are never boilerplate. Repeated rows are pages of their own, a line
    repeated within a page counts once and is dropped wherever it stands. An empty table gives
    an empty table. Other columns pass through inside the struct, so no name can clash.
    With ``near_copies_count_once``, which needs doc_id and text and ``copies_count_once``, lines found
    so must be found again once near copies among the pages that have them count as one page.

    The boilerplate lines are written once. Up to ``broadcast_lines`` of them are broadcast;
    beyond, they are joined by host and salt, so that a host with most pages is dealt out.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    own = df.select(row.alias("row"), F.coalesce(host, F.lit("\0null")).alias("_host"), lines.alias("_lines"))
    bad = saved(boilerplate(own, ratio, min_pages, copies_count_once), "boilerplate")
    size = F.coalesce(F.sum(F.size("_drop")), F.lit(0))
    n_bad = bad.agg(size).first()[0]
    joined = with_drop(own, bad, n_bad, broadcast_lines, salts)
    if near_copies_count_once and n_bad:
        bad = saved(boilerplate(with_near_copies(joined), ratio, min_pages, True, F.col("_page")), "boilerplate")
        joined = with_drop(own, bad, bad.agg(size).first()[0], broadcast_lines, salts)
    keep = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x: ~F.array_contains("_drop", F.xxhash64(x))))
    out = joined.withColumn("kept", keep)
    return out.select("row", "kept", F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("kept")).cast("long").alias("n_dropped"))


def page_line_dedup(pages: DataFrame, ratio: float = 0.2, min_pages: int = 3) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, text) of ``pages``: page_id, url, html."""
    out = line_dedup(pages.select("page_id", "url", "html"), url_host(F.col("url")), page_lines(F.col("html")), ratio, min_pages)
    return out.select("row.page_id", url_host(F.col("row.url")).alias("host"), "n_lines", "n_dropped", F.array_join("kept", "\n").alias("text"))


def document_line_dedup(docs: DataFrame, ratio: float = 0.2, min_pages: int = 3, **options) -> DataFrame:
    """``docs`` with boilerplate lines gone from text; the source is the host, and exact and near copies count once.

    No row goes: a document of boilerplate alone is kept with an empty text. A null text becomes
    empty. n_chars follows the text.
    """
    out = line_dedup(docs, F.col("source"), text_lines(F.col("text")), ratio, min_pages, copies_count_once=True, near_copies_count_once=True, **options)
    text = F.array_join("kept", "\n")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select([new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


#: The query over pages in DuckDB.
PAGES_SQL = r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         [x for x in [trim(y, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))
                      for y in regexp_split_to_array(coalesce(html, ''), '<[^>]*>|[\r\n]')] if x <> ''] AS lines,
         row_number() OVER () AS r
  FROM pages),
n AS (SELECT host, count(*) AS total FROM p GROUP BY host),
l AS (SELECT host, line, count(*) AS pages
      FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
bad AS (SELECT l.host, list(l.line) AS gone FROM l JOIN n USING (host)
        WHERE l.pages >= 3 AND l.pages > 0.2 * n.total GROUP BY l.host),
k AS (SELECT p.page_id, p.host, p.lines,
             [x for x in p.lines if NOT list_contains(coalesce(bad.gone, []), x)] AS kept
      FROM p LEFT JOIN bad USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines,
       CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text
FROM k
"""
