"""Words and shingles of many texts at once, as arrays: for use inside tasks.

Hashes are 64 bits wide: a byte polynomial modulo 2^64, taken from running sums, and mixed with
the word's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Odd multipliers of the polynomial (BASE * UNBASE = 1 modulo 2^64) and of the mixer.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX[0])
    x ^= x >> np.uint64(27)
    x = x * np.uint64(MIX[1])
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, null as empty, without a copy of the bytes."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def pieces(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of rows of about ``limit`` bytes; a longer row is a run of its own."""
    data, at = buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, UNBASE):
        x = np.full(n + 1, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


class Words:
    """Finds words in runs of rows; keeps the table of powers between runs."""

    def __init__(self):
        self.up, self.down = powers(1 << 16)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self.up, self.down = powers(max(len(data), 1 << 20))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(MIX[1]))

    def find(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end) of each run of anything but ASCII white space; runs end where rows end."""
        if not len(data):
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        opens, closes = np.empty(len(data), bool), np.empty(len(data), bool)
        opens[0] = closes[-1] = True
        opens[1:], closes[:-1] = blank[:-1], blank[1:]
        full = at[1:] > at[:-1]
        opens[at[:-1][full]] = True
        closes[at[1:][full] - 1] = True
        starts, ends = np.flatnonzero(opens & ~blank), np.flatnonzero(closes & ~blank) + 1
        return np.searchsorted(at, starts, "right") - 1, starts, ends


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def runs_of(rows: np.ndarray, h: np.ndarray, k: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of k consecutive words; the whole sequence of a row with fewer words."""
    count = np.bincount(rows, minlength=n_rows)
    step = np.uint64(BASE)
    if len(h) >= k:
        inside = rows[: len(rows) - k + 1] == rows[k - 1 :]
        acc = h[: len(h) - k + 1]
        for j in range(1, k):
            acc = mix(acc * step + h[j : len(h) - k + 1 + j])
        out_rows, out = rows[: len(rows) - k + 1][inside], acc[inside]
    else:
        out_rows, out = rows[:0], h[:0]
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        first = np.cumsum(count) - count
        acc = h[first[few]]
        for j in range(1, k - 1):
            more = count[few] > j
            acc[more] = mix(acc[more] * step + h[first[few][more] + j])
        out_rows, out = np.concatenate([out_rows, few]), np.concatenate([out, acc])
        order = np.argsort(out_rows, kind="stable")
        out_rows, out = out_rows[order], out[order]
    return out_rows, out


def distinct(rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash), in order of row and hash."""
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
    return rows[keep], h[keep]
