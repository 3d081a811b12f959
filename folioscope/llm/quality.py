"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance of transformed statistics of its training documents. A
covariance is shrunk towards the pooled one and that towards a multiple of the identity. A
document's score is the logistic function of the difference of the two log densities, each from
a Mahalanobis distance by the covariance's Cholesky factor, which is computed once on the driver
and travels with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import held_out, training_rows, training_texts
from folioscope.llm.words import Words, mix, pieces

#: The statistics; shares start from a text of 60 bytes and 12 words of ordinary prose, so that a few words are not far off.
NAMES = (
    "mean_word", "upper", "digit", "blank", "closing", "mark", "high", "shouted", "marked", "again", "stutter", "top", "repeated_line", "long_line",
)
PRIOR_BYTES, PRIOR_WORDS = 60.0, 12.0
ORDINARY = {"upper": 0.03, "blank": 0.16, "closing": 0.03, "high": 0.02, "again": 0.1}
CLOSING, MARKS = b".,;:?'\"()-", b"!#$%&*+/<=>@[\\]^_`{|}~"


def statistics(data: np.ndarray, at: np.ndarray, words: Words) -> np.ndarray:
    """The transformed statistics, a row for each of the texts laid end to end.

    Lengths go in as logarithms and shares as square roots, which brings both nearer to a normal
    distribution. A text without bytes has those of ordinary prose.
    """
    n = len(at) - 1
    size = np.diff(at).astype(float)

    def count(hit: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(hit) + 1, np.int64)
        np.cumsum(hit, out=sums[1:])
        return (sums[at[1:]] - sums[at[:-1]]).astype(float)

    kind = np.zeros(256, np.uint8)
    kind[65:91], kind[48:58], kind[128:] = 1, 2, 6
    kind[list(b" \t\n\x0b\x0c\r")], kind[list(CLOSING)], kind[list(MARKS)] = 3, 4, 5
    kinds = kind[data]
    upper, digit, blank, closing, mark, high = (count(kinds == k) for k in range(1, 7))
    lines = count(data == 10) + 1
    row, starts, ends = words.find(data, at)
    n_words = np.bincount(row, minlength=n).astype(float)
    each = np.zeros(len(data) + 1, np.int64)
    np.cumsum((kinds == 1) & np.ones(len(data), bool), out=each[1:])
    lower = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 97) & (data <= 122), out=lower[1:])
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kinds == 5, out=marks[1:])
    of = lambda s: s[ends] - s[starts]
    shouted = np.bincount(row, (of(each) >= 2) & (of(lower) == 0), minlength=n)
    bare = np.bincount(row, of(marks) >= 1, minlength=n)
    h = words.hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    stutter = np.bincount(row[1:], (row[1:] == row[:-1]) & (h[1:] == h[:-1]), minlength=n)
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])
    distinct = np.bincount(row[order][new], minlength=n)
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, row[order][new], runs)
    # Lines are the runs between line feeds; the share of bytes in lines that stood before.
    edge = np.unique(np.concatenate([at, np.flatnonzero(data == 10) + 1]))
    first, last = edge[:-1], edge[1:]
    repeated = np.zeros(n)
    if len(first):
        line_row = np.searchsorted(at, first, "right") - 1
        lh = mix(words.hashes(data, first, last))
        order = np.lexsort((first, lh, line_row))
        again = np.zeros(len(lh), bool)
        again[1:] = (line_row[order][1:] == line_row[order][:-1]) & (lh[order][1:] == lh[order][:-1])
        repeated = np.bincount(line_row[order], again * (last - first)[order], minlength=n)
    letters = np.maximum(size - blank, 0)
    of_bytes = {"upper": upper, "digit": digit, "blank": blank, "closing": closing, "mark": mark, "high": high, "repeated_line": repeated}
    of_words = {"shouted": shouted, "marked": bare, "again": n_words - distinct, "stutter": stutter, "top": np.maximum(top - 1, 0)}
    columns = {name: np.sqrt((a + PRIOR_BYTES * ORDINARY.get(name, 0.0)) / (size + PRIOR_BYTES)) for name, a in of_bytes.items()}
    columns |= {name: np.sqrt((a + PRIOR_WORDS * ORDINARY.get(name, 0.0)) / (n_words + PRIOR_WORDS)) for name, a in of_words.items()}
    columns["mean_word"] = np.log((letters + PRIOR_BYTES) / (n_words + PRIOR_WORDS))
    columns["long_line"] = np.log1p(size / lines)
    return np.column_stack([columns[name] for name in NAMES])


@dataclass
class Discriminant:
    """Two classes' means, inverse Cholesky factors and log-density constants, in standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row of statistics."""
        z = (x - self.centre) / self.scale
        log = [c - 0.5 * (((z - m) @ f) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1.0 / (1.0 + np.exp(-np.clip(log[1] - log[0], -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, shrink: float = 0.3, ridge: float = 0.01) -> Discriminant:
    """The discriminant of training rows: shrink is the weight of the pooled covariance, ridge that of the identity.

    A class without rows gets the other's mean and covariance, so its share alone decides.
    """
    if not len(x):
        x, y = np.zeros((2, len(NAMES))), np.array([0, 1])
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - centre) / scale
    d = z.shape[1]
    groups = [z[y == c] if (y == c).any() else z for c in (0, 1)]
    spread = [np.atleast_2d(np.cov(g.T, bias=True)) for g in groups]
    pooled = sum(len(g) * s for g, s in zip(groups, spread)) / sum(map(len, groups))
    factors, constants = [], []
    for c, s in enumerate(spread):
        s = (1 - shrink) * s + shrink * pooled
        s = (1 - ridge) * s + ridge * max(np.trace(s) / d, 1e-6) * np.eye(d)
        lower = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(lower).T)
        constants.append(float(np.log(((y == c).sum() + 1) / (len(y) + 2)) - np.log(np.diag(lower)).sum()))
    return Discriminant(centre, scale, [g.mean(axis=0) for g in groups], factors, constants)


def over_batches(column: pa.Array, words: Words) -> Iterator[tuple[int, int, np.ndarray]]:
    for i, j, data, at in pieces(column):
        yield i, j, statistics(data, at, words)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000) -> Discriminant:
    """Fits on the statistics of at most ``max_rows`` labelled documents that are not held out.

    The bound holds for the fit alone. Their ids are broadcast, so no other text is moved; each
    gives 15 numbers to the driver, its label and its statistics.
    """
    rows = training_rows(labels, label, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for i, j, x in over_batches(batch.column(1), words):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i)] + [pa.array(c) for c in x.T], ["y", *NAMES])

    found = training_texts(docs, rows).select("y", "text").mapInArrow(run, ", ".join(["y int", *(f"{n} double" for n in NAMES)]))
    table = found.toPandas()
    return fit(table[list(NAMES)].to_numpy(float).reshape(-1, len(NAMES)), table["y"].to_numpy())


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``: doc_id, text.

    Null and empty texts are scored by their statistics, which are those of ordinary prose. A null
    doc_id is not held out. Repeated rows are scored alike; of an id's several texts, the one of smallest
    hash is learned from. A very long text is one row's work, in memory and time linear in its
    length. Without usable labels every score is a half; an empty table gives no rows. Other
    columns, whatever their names, are not read.
    """
    docs = docs.select("doc_id", "text")
    model = train(docs, labels, max_rows=max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for i, j, x in over_batches(batch.column(1), words):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(model.score(x))], ["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
