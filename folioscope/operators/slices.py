"""Tokens of numbered lines grouped by term, as arrays: for use inside tasks.

Each function is for mapInArrow on (docid, tokens). Lines are taken in slices of some hundred thousand tokens, and a slice's tokens
are put in order of term, line and place by one sort of numbers. A line is never cut, so a very long one is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from folioscope.functions.stem import stem

#: Tokens of a slice, and its lines, at most.
SLICE = 1 << 20


@dataclass
class Slice:
    """Rows of (term, docid), in order of both: ``terms`` are distinct and in order, ``begin`` is where a row's places begin in ``places``."""

    terms: pa.Array
    term: np.ndarray
    docid: np.ndarray
    begin: np.ndarray
    places: np.ndarray

    @property
    def tf(self) -> np.ndarray:
        return np.diff(self.begin)


def slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(docids, tokens of each, the tokens) of runs of a batch's rows whose docids are consecutive, ``SLICE`` tokens or one row at most."""
    docid, lists = batch.column(0).to_numpy(), batch.column(1)
    n, tokens = len(docid), lists.flatten()
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy())])
    ends = np.append(np.flatnonzero(np.diff(docid) != 1) + 1, n)
    i = 0
    while i < n:
        j = min(int(np.searchsorted(at, at[i] + SLICE, "right")) - 1, int(ends[np.searchsorted(ends, i, "right")]), i + SLICE)
        j = max(j, i + 1)
        if at[j] > at[i]:
            yield docid[i:j], np.diff(at[i : j + 1]), tokens.slice(at[i], at[j] - at[i])
        i = j


def grouped(docid: np.ndarray, lengths: np.ndarray, tokens: pa.Array) -> Slice:
    """A slice's rows. The sort key has a token's term, and its number in the slice, which tells line and place."""
    coded = tokens.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    n = len(tokens)
    key = np.sort(rank[coded.indices.to_numpy()] << 32 | np.arange(n))
    term, number = key >> 32, key & 0xFFFFFFFF
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(lengths)), lengths)[number]
    change = np.ones(n, bool)
    change[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(change)
    return Slice(coded.dictionary.take(pa.array(order)), term[first], docid[row[first]], np.append(first, n), (number - starts[row]).astype(np.int32))


def of(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for batch in batches:
        for own in slices(batch):
            yield grouped(*own)


def table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def postings_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, docid, tf, positions)."""
    for s in of(batches):
        positions = pa.ListArray.from_arrays(pa.array(s.begin.astype(np.int32)), pa.array(s.places))
        yield table(term=s.terms.take(pa.array(s.term)), docid=s.docid, tf=s.tf, positions=positions)


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, docid, tf)."""
    for s in of(batches):
        yield table(term=s.terms.take(pa.array(s.term)), docid=s.docid, tf=s.tf)


def gaps_inside(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(whether a row is its term's first of the slice, docid less the one before it in the slice)."""
    first = np.ones(len(s.term), bool)
    first[1:] = s.term[1:] != s.term[:-1]
    return first, np.diff(s.docid, prepend=0)


def gap_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, docid, gap, last): a term's first row of a slice has no gap, but the term's last docid there; other rows have a gap alone."""
    for s in of(batches):
        first, gap = gaps_inside(s)
        last = np.zeros(len(first), np.int64)
        last[first] = s.docid[np.append(np.flatnonzero(first)[1:], len(first)) - 1]
        yield table(term=s.terms.take(pa.array(s.term)), docid=s.docid, gap=pa.array(gap, mask=first), last=pa.array(last, mask=~first))


def vbytes(n: np.ndarray) -> np.ndarray:
    """``functions.text.vbyte_length`` of an array."""
    return 1 + sum((n >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))


def steps(s: Slice) -> np.ndarray:
    """Each place less the one before it in its row, the first less 0."""
    step = np.diff(s.places, prepend=0)
    step[s.begin[:-1]] = s.places[s.begin[:-1]]
    return step


def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, docid, pos, gap)."""
    for s in of(batches):
        tf = s.tf
        term = s.terms.take(pa.array(np.repeat(s.term, tf)))
        yield table(term=term, docid=np.repeat(s.docid, tf), pos=s.places.astype(np.int64), gap=steps(s).astype(np.int64))


def size_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df, b, first, last) of a slice's terms: documents, bytes of tf, positions and of the gaps inside the slice, first and last docid."""
    for s in of(batches):
        first, gap = gaps_inside(s)
        b = np.add.reduceat(vbytes(steps(s)), s.begin[:-1]) + vbytes(s.tf) + np.where(first, 0, vbytes(gap))
        at = np.flatnonzero(first)
        ends = np.append(at[1:], len(first))
        yield table(term=s.terms, df=ends - at, b=np.add.reduceat(b, at), first=s.docid[at], last=s.docid[ends - 1])


def stem_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(docid, pos, stem): a slice's distinct tokens are stemmed once each."""
    for batch in batches:
        for docid, lengths, tokens in slices(batch):
            coded = tokens.dictionary_encode()
            stems = pa.array([stem(t) for t in coded.dictionary.to_pylist()], pa.string())
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield table(docid=np.repeat(docid, lengths), pos=pos.astype(np.int32), stem=stems.take(coded.indices))
