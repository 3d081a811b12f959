"""URLs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scheme, authority and path as RFC 3986 cuts a reference.
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)"


def normalize_url(url: Column) -> Column:
    """Lower-case scheme (http if none) and authority; no parameters, query or fragment; no slash at the end of a path."""
    part = lambda i: F.regexp_extract(url, PARTS, i)
    scheme = F.when(part(1) == "", F.lit("http")).otherwise(F.lower(part(1)))
    path = F.regexp_replace(part(3), ";[^/]*$", "")
    path = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/$", ""))
    return F.concat(scheme, F.lit("://"), F.lower(part(2)), path)


def seed_url(title: Column, base_url: str) -> Column:
    """The page of a title: blanks as underscores, percent-encoded but for slashes, after ``base_url``, normalized."""
    quoted = F.url_encode(F.translate(title, " ", "_"))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        quoted = F.replace(quoted, F.lit(a), F.lit(b))
    return normalize_url(F.concat(F.lit(base_url), quoted))


def host_of(url: Column) -> Column:
    """A URL's authority in lower case; "" where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, PARTS, 2)), F.lit(""))
