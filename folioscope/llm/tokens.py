"""Words between separator bytes, of many texts at once, as arrays: for use inside tasks.

Separators are ASCII, so the words of UTF-8 texts are found in their bytes. Texts are taken in runs of
about a megabyte; a longer one comes in parts that are cut after a separator, so a task's memory does
not grow with the longest text but for that text's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from folioscope.llm.words import Words, lower_ascii, pieces

#: Bytes of text that are split at a time.
LONG = 1 << 20


def bytes_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes of the ranges, both ends included."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Space and the white space of ASCII.
WHITE = bytes_table((0x09, 0x0D), (0x20, 0x20))


@dataclass
class Run:
    """Words of the rows ``first`` to ``last`` (exclusive) of a batch; ``goes_on`` if the last row has further parts."""

    first: int
    last: int
    goes_on: bool
    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def words(self, at: np.ndarray) -> list[bytes]:
        """The bytes of the words numbered ``at``."""
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist())]


def parts(data: np.ndarray, separators: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """``data`` in parts of ``limit`` bytes or little more, cut after a separator; a longer word stays whole."""
    at = 0
    while len(data) - at > limit:
        look = at + limit
        cut = None
        while cut is None and look < len(data):
            hit = np.flatnonzero(separators[data[look : look + limit]])
            cut, look = (look + int(hit[0]) + 1, look) if len(hit) else (None, look + limit)
        if cut is None:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


class Splitter:
    """Splits columns of texts into words: runs of bytes that are no ``separators``, A-Z lower-cased if ``lower``."""

    def __init__(self, separators: np.ndarray, lower: bool, limit: int = LONG):
        self.separators, self.lower, self.limit, self.hasher = separators, lower, limit, Words()

    def runs(self, column: pa.Array) -> Iterator[Run]:
        """The runs of a column, in order; null has no words."""
        for i, j, data, at in pieces(column, self.limit):
            if j == i + 1 and len(data) > self.limit:
                own = list(parts(data, self.separators, self.limit))
                for n, part in enumerate(own):
                    yield self._run(i, j, n + 1 < len(own), part, np.array([0, len(part)]))
            else:
                yield self._run(i, j, False, data, at)

    def _run(self, first: int, last: int, goes_on: bool, data: np.ndarray, at: np.ndarray) -> Run:
        data = lower_ascii(data) if self.lower else data
        inside = ~self.separators[data]
        # A word begins after a separator or where a row begins, and ends likewise.
        new = np.zeros(len(data) + 1, bool)
        new[at] = True
        start = np.flatnonzero(inside & (new[:-1] | ~np.concatenate([[False], inside[:-1]])))
        end = np.flatnonzero(inside & (new[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        row = np.searchsorted(at, start, "right") - 1 + first
        hashes = self.hasher.hashes(data, start, end) if len(start) else np.zeros(0, np.uint64)
        return Run(first, last, goes_on, data, row, start, end, hashes)
