"""Toxicity by a learned lexicon, matched through Levenshtein automata.

Stems that set toxic training documents apart are learned as prefixes of words. The lexicon is a
trie; its intersection with the Levenshtein automata of its stems is one deterministic automaton
whose states, sets of (trie node, edits), are made as words need them. It reads a word once and
gives the stem that the word begins with, up to one edit for stems of five letters or more and
two for ten or more. Each occurrence is weighed by its stem, its edits and its window of words:
between quotation marks, an occurrence is a mention and counts less. A logistic model of
a document's strongest windows and of their sum gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import held_out, saved, tidied, training_rows, training_texts
from folioscope.llm.near_dedup import shingle_sets
from folioscope.llm.words import Words, mix

#: A word; @ and $ may stand in for its letters. Its fragments are what they part.
TOKEN = re.compile(r"[@$]*[^\W_]+(?:[@$]+[^\W_]+)*[@$]*")
FRAGMENT = re.compile(r"[^\W_]+")
#: Letters and digits that stand in for letters, as a fixed value: what is read as what.
READ_AS = str.maketrans("013457@$", "oieastas")
#: Letters of a learned stem. Words that go on are found by how they begin.
SHORTEST, LONGEST = 3, 20
#: By how much a stem's log likelihood ratio must exceed the logarithm of the number of prefixes tried: one in e^3 trials of a whole corpus has a stem by chance.
EVIDENCE = 3.0
WINDOW = 8
QUOTED = 0.35
OPENING, CLOSING = "\"“„«‹‘", "\"”“»›’"


def allowed_edits(stem: str) -> int:
    return 0 if len(stem) < 5 else 1 if len(stem) < 10 else 2


def normal(text: str) -> str:
    return text.lower()


@dataclass
class Lexicon:
    """Stems and whole words in a trie, and the automaton that finds them with edits.

    A state is a frozen set of (node, edits) held as a number; state 0 is dead. ``accepts`` has, for a
    state, the best (edits, stem number) among its ends.
    """

    stems: list[str]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[int] = field(default_factory=lambda: [-1])
    most: list[int] = field(default_factory=lambda: [0])
    states: list[dict[int, int]] = field(default_factory=list)
    numbers: dict[frozenset, int] = field(default_factory=dict)
    steps: list[dict[str, int]] = field(default_factory=list)
    accepts: list[tuple[int, int] | None] = field(default_factory=list)

    def __post_init__(self):
        for i, stem in enumerate(self.stems):
            node = 0
            for c in stem:
                self.most[node] = max(self.most[node], allowed_edits(stem))
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
            self.ends[node] = i
            self.most[node] = max(self.most[node], allowed_edits(stem))
        self._number({})
        self.start = self._number(self._closed({0: 0}))

    def _closed(self, state: dict[int, int]) -> dict[int, int]:
        """With the nodes that leaving letters of a stem out leads to."""
        todo = list(state.items())
        while todo:
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits < self.most[child] and edits + 1 < state.get(child, NEVER):
                    state[child] = edits + 1
                    todo.append((child, edits + 1))
        return state

    def _number(self, state: dict[int, int]) -> int:
        key = frozenset(state.items())
        if (n := self.numbers.get(key)) is None:
            n = self.numbers[key] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            found = [(edits, self.ends[node]) for node, edits in state.items() if self.ends[node] >= 0 and edits <= allowed_edits(self.stems[self.ends[node]])]
            self.accepts.append(min(found) if found else None)
        return n

    def _step(self, number: int, char: str) -> int:
        after: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.most[node] and edits < after.get(node, NEVER):
                after[node] = edits

        for node, edits in self.states[number].items():
            reach(node, edits + 1)  # a letter too many
            for c, child in self.children[node].items():
                reach(child, edits + (c != char))
        n = self.steps[number][char] = self._number(self._closed(after))
        return n

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, stem) of the stem nearest to how the word begins, or None. Fewest edits win."""
        at, best = self.start, None
        for char in word:
            at = self.steps[at].get(char, -1) if char in self.steps[at] else self._step(at, char)
            if not at:
                break
            if (hit := self.accepts[at]) is not None and (best is None or hit < best):
                best = hit
        return best

    def find_both(self, word: str) -> tuple[int, int] | None:
        """As ``find``, also for the word with look-alike characters read as letters, as one edit more."""
        best = self.find(word)
        if (best is None or best[0]) and (plain := word.translate(READ_AS)) != word and any(map(str.isalpha, word)):
            other = self.find(plain)
            if other is not None and (best is None or other < best):
                best = (max(1, other[0]), other[1])
        return best

    def find_all(self, word: str) -> list[tuple[int, int]]:
        """What ``find_both`` has for each fragment of the word; if for none, for the whole word."""
        fragments = FRAGMENT.findall(word)
        hits = [hit for x in fragments if (hit := self.find_both(x)) is not None]
        if not hits and fragments != [word] and (whole := self.find_both(word)) is not None:
            hits = [whole]
        return hits


NEVER = 1 << 30
#: States of the automaton that a task keeps; beyond, it makes them anew as words need them.
MOST_STATES = 200_000
#: Words that a task remembers to be in the lexicon or not.
MOST_KNOWN = 150_000


def copy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow on (y, text, h): with keys, the smallest of a text's shingles of five words in three orders, and the shingles.

    Texts without words have neither, so they are nobody's copies here.
    """
    words = Words()
    for batch in batches:
        for i, j, rows, h in shingle_sets(batch.column(1), 5, words):
            n = np.bincount(rows, minlength=j - i)
            some = np.flatnonzero(n)
            keys = [np.minimum.reduceat(mix(h ^ np.uint64(k + 1)), (np.cumsum(n) - n)[some]) if len(h) else h for k in range(3)]
            offsets = [np.concatenate([[0], np.cumsum(x)]).astype(np.int32) for x in (3 * (n > 0), n)]
            flat = [np.column_stack(keys).ravel(), h]
            arrays = [pa.ListArray.from_arrays(pa.array(o), pa.array(x.view(np.int64))) for o, x in zip(offsets, flat)]
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in range(3)] + arrays, ["y", "text", "h", "keys", "shingles"])


def without_copies(train: DataFrame) -> DataFrame:
    """The rows (y, text) of ``train``, of copies and near copies only the one of smallest hash.

    Equal texts are one row, of the smallest y. Near copies share half of their shingles or more; those that share one of three
    smallest shingles are compared on their whole sets.
    """
    one = train.groupBy("text").agg(F.min("y").alias("y")).select("y", "text", F.xxhash64("text").alias("h"))
    rows = saved(one.mapInArrow(tidied(copy_keys), "y int, text string, h long, keys array<long>, shingles array<long>"), "training-sets")
    each = rows.select("h", F.explode("keys").alias("k"))
    hubs = each.groupBy("k").agg(F.min("h").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "hub")
    met = each.join(F.broadcast(hubs), "k").where("h != hub").select("h", "hub").distinct()  # at most three hubs for two rows
    met = saved(met, "training-copies")
    ids = met.select("h").union(met.select("hub")).distinct()
    sets = rows.select("h", "shingles").join(F.broadcast(ids), "h", "left_semi")  # ids of training rows, which are bounded
    both = met.join(sets.toDF("h", "a"), "h").join(sets.toDF("hub", "b"), "hub").withColumn("shared", F.size(F.array_intersect("a", "b")))
    gone = both.where(2 * F.col("shared") >= F.size("a") + F.size("b") - F.col("shared")).select("h").distinct()
    return rows.join(gone, "h", "left_anti").select("y", "text")


COUNTS = ("toxic", "clean", "toxic_twice", "clean_twice")


#: Prefixes that a task counts before it hands its counts on and begins anew.
PREFIXES = 50_000


def prefix_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow on (y, text): in how many documents of each class words begin with each prefix, once and twice.

    A prefix may come several times, with counts to be summed.
    """
    counts: dict[str, list[int]] = {}

    def handed_on() -> pa.RecordBatch:
        columns = [pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(4)]
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *columns], ["prefix", *COUNTS])
        counts.clear()
        return batch

    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = Counter(FRAGMENT.findall(normal(text or "")))
            own: Counter = Counter()
            for w, times in words.items():
                for n in range(SHORTEST, min(LONGEST, len(w)) + 1):
                    own[w[:n]] += times
            for p, times in own.items():
                c = counts.setdefault(p, [0, 0, 0, 0])
                c[1 - y] += 1
                c[3 - y] += times > 1
            if len(counts) >= PREFIXES:
                yield handed_on()
    yield handed_on()


def learn_stems(train: DataFrame, n_toxic: int, n_clean: int, least: int, ratio: float) -> list[str]:
    """The stems of words in ``least`` toxic documents or more, ``ratio`` times as often as in clean ones.

    That this is no chance needs evidence: a log likelihood ratio of ``EVIDENCE`` beyond the logarithm of how many prefixes
    are tried, each of which may seem to tell by chance. Either documents with such words count or, for stems that clean text has by chance,
    documents with several. Counts are summed by Spark; all candidates that pass come to the driver, which
    are few, as each needs ``least`` of the bounded training rows. Of the
    prefixes of one word, the longest with nearly the same toxic documents, or most of them and
    half the clean ones, stands for the shorter ones, and a chosen stem for all that continue it.
    """
    counts = train.select("y", "text").mapInArrow(tidied(prefix_counts), ", ".join(["prefix string", *(f"{c} long" for c in COUNTS)]))
    counts = saved(counts.groupBy("prefix").agg(*[F.sum(c).alias(c) for c in COUNTS]).where(F.col("toxic") + F.col("clean") >= least), "prefixes")
    needed = EVIDENCE + math.log(max(counts.count(), 1))

    def tells(toxic: str, clean: str) -> Column:
        odds = (F.col(toxic) + 0.5) / F.lit(n_toxic + 1.0) / ((F.col(clean) + 0.5) / F.lit(n_clean + 1.0))
        n, share = F.col(toxic) + F.col(clean), n_toxic / (n_toxic + n_clean)
        told = F.col(toxic) * F.log(F.col(toxic) / (n * share))
        if n_clean:
            told += F.when(F.col(clean) > 0, F.col(clean) * F.log(F.col(clean) / (n * (1 - share)))).otherwise(0.0)
        return (F.col(toxic) >= least) & (odds >= ratio) & (told >= needed)

    found = counts.where(tells("toxic", "clean") | tells("toxic_twice", "clean_twice"))
    rows = found.select("prefix", "toxic", "clean").collect()
    toxic, clean = {r.prefix: r.toxic for r in rows}, {r.prefix: r.clean for r in rows}
    grown = set()
    for p, n in toxic.items():
        if (short := p[:-1]) in toxic and (n >= 0.95 * toxic[short] or n >= 0.8 * toxic[short] and clean[p] < 0.5 * clean[short]):
            grown.add(short)
    chosen: set[str] = set()
    for p in sorted(toxic, key=len):
        if p not in grown and not any(p[:n] in chosen for n in range(SHORTEST, len(p))):
            chosen.add(p)
    return sorted(chosen)


def quoted_places(text: str) -> list[tuple[int, int]]:
    """The stretches of a line between an opening and the next closing quotation mark."""
    return [m.span() for m in re.finditer(f"[{OPENING}][^\n{OPENING}{CLOSING}]*[{CLOSING}]", text)]


def occurrences(text: str, lexicon: Lexicon, known: dict) -> list[tuple[int, int, int, bool]]:
    """(word number, stem, edits, quoted) of each lexicon word of a text in lower case."""
    words = TOKEN.findall(text)
    hits = {}
    for w in set(words):
        if w not in known:
            known[w] = lexicon.find_all(w)
        if known[w]:
            hits[w] = known[w]
    if not hits:
        return []
    quotes = quoted_places(text)
    out = []
    for i, m in enumerate(TOKEN.finditer(text)):
        for edits, stem in hits.get(m[0], ()):
            out.append((i, stem, edits, any(s <= m.start() < e for s, e in quotes)))
    return out


def window_features(found: list[tuple[int, int, int, bool]], weights: np.ndarray, n_words: int) -> tuple[float, float, float]:
    """(weight of the heaviest window, of all occurrences, of all a word) from weights by (stem, edits)."""
    if not found:
        return 0.0, 0.0, 0.0
    w = [max(0.0, weights[s, min(e, 2)]) * (QUOTED if q else 1.0) for _, s, e, q in found]
    best = total = 0.0
    first = 0
    for i, (place, *_) in enumerate(found):
        total += w[i]
        while found[first][0] < place - WINDOW:
            first += 1
        best = max(best, sum(w[first : i + 1]))
    return math.log1p(best), math.log1p(total), math.sqrt(total / max(n_words, 1))


class Finder:
    """Finds lexicon words in texts; what it remembers of words and automata is forgotten when it has grown to a bound."""

    def __init__(self, stems: list[str]):
        self.stems, self.lexicon, self.known = stems, Lexicon(stems), {}

    def find(self, low: str) -> list[tuple[int, int, int, bool]]:
        if len(self.known) > MOST_KNOWN:
            self.known.clear()
        if len(self.lexicon.states) > MOST_STATES:
            self.lexicon = Lexicon(self.stems)
        return occurrences(low, self.lexicon, self.known)


@dataclass
class Detector:
    stems: list[str]
    weights: np.ndarray
    coefficients: np.ndarray


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    """Coefficients, the constant first, by Newton's method."""
    z = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + l2 * np.eye(len(b)), z.T @ (y - p) - l2 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def log_odds(counts: np.ndarray, n: list[int]) -> np.ndarray:
    """Log odds of toxic from (2, ...) numbers of clean and toxic documents, of ``n`` each."""
    return np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))


def pairs_of(found: list[tuple[int, int, int, bool]]) -> set[tuple[int, int]]:
    """The (stem, edits) that a document has, two edits being the most that are told apart."""
    return {(s, min(e, 2)) for _, s, e, _ in found}


def own_left_out(counts: np.ndarray, n: list[int], y: int, pairs: set[tuple[int, int]]) -> np.ndarray:
    """The weights of all training documents but one of class ``y`` with these ``pairs``."""
    weights = log_odds(counts, n)
    if pairs:
        cells = tuple(np.array(list(pairs)).T)
        rest = counts[:, *cells]
        rest[y] -= 1
        weights[cells] = log_odds(rest, n)
    return weights


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 20_000, least: int = 5, ratio: float = 20.0) -> Detector:
    """Learns stems, weights and the logistic model from at most ``max_rows`` labelled rows that are not held out.

    Of near copies among them one counts, else their chance words would pass for signs. Their ids
    are broadcast, so no other text is moved. The driver gets the stems, how many documents
    have each at each number of edits, and three features of each training document. Weights are log odds of
    a document's class given the stem at that many edits, of the other training documents: each
    document's own is left out.
    """
    own = saved(without_copies(training_texts(docs, training_rows(labels, label, max_rows))), "training-texts")
    totals = {r.y: r.n for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [totals.get(0, 0), totals.get(1, 0)]
    stems = learn_stems(own, n[1], n[0], least, ratio) if n[1] else []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(stems)
        for batch in batches:
            met: Counter = Counter()
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                met.update((y, *pair) for pair in pairs_of(finder.find(normal(text or ""))))
            rows = [(*k, v) for k, v in met.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["y", "stem", "edits", "n"])

    counts = np.zeros((2, max(len(stems), 1), 3))
    for r in own.mapInArrow(tidied(count), "y long, stem long, edits long, n long").groupBy("y", "stem", "edits").agg(F.sum("n").alias("n")).collect():
        counts[r.y, r.stem, r.edits] = r.n

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(stems)
        for batch in batches:
            x = []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low = normal(text or "")
                found = finder.find(low)
                weights = own_left_out(counts, n, y, pairs_of(found)) if found else counts
                x.append((y, *window_features(found, weights, len(TOKEN.findall(low)) if found else 0)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*x), [pa.int32(), *[pa.float64()] * 3])], ["y", "best", "total", "share"])

    table = own.mapInArrow(tidied(describe), "y int, best double, total double, share double").collect()
    x, y = np.array([r[1:] for r in table], float).reshape(-1, 3), np.array([r.y for r in table], float)
    return Detector(stems, log_odds(counts, n), logistic(x, y) if len(y) else np.zeros(4))


def scorer(model: Detector):
    """A function from texts to (scores, numbers of terms), with one lexicon and memory for a task."""
    finder = Finder(model.stems)

    def score(texts: Iterator[str | None]) -> tuple[np.ndarray, list[int]]:
        x, n = [], []
        for text in texts:
            low = normal(text or "")
            found = finder.find(low)
            n.append(len(found))
            x.append(window_features(found, model.weights, len(TOKEN.findall(low)) if found else 0))
        z = np.column_stack([np.ones(len(x)), np.array(x).reshape(-1, 3)]) @ model.coefficients
        return 1 / (1 + np.exp(-np.clip(z, -500, 500))), n

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_terms) of each row of ``docs``: doc_id, text.

    Null and empty texts are scored as texts without terms. A null doc_id is not held out.
    Repeated rows are scored alike; of an id's several texts, the one of smallest hash is learned from. A very
    long text is one row's work, linear in its length. Without usable labels there are no terms
    and every score is a half; an empty table gives no rows. Other columns, whatever their names, are not read.
    """
    docs = docs.select("doc_id", "text")
    model = train(docs, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in batches:
            p, n = score(x.as_py() for x in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(n, pa.int64())], ["doc_id", "score", "n_terms"])

    scored = docs.mapInArrow(tidied(run), "doc_id long, score double, n_terms long")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_terms")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns, whatever their names.

    Null and empty texts are scored as texts without terms, repeated rows alike, and rows without
    a doc_id as others. If no term was learned, whatever the labels say of how common toxic texts
    are, nothing in a text speaks against it and all rows stay. An empty table gives none.
    """
    model = train(docs.select("doc_id", "text"), labels, **options)
    if not model.stems:
        return docs
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in batches:
            p, _ = score(x.as_py() for x in batch.column(place))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(tidied(run), docs.schema)
