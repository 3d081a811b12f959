"""Token counts without the tokens: a forward pass that carries only state and count.

An Aho-Corasick automaton of the vocabulary lists all pieces that end at each character of a
distinct marked word. The forward pass takes the best by the tokenizer's rules, for unigram
models the highest 32-bit sum of scores and of equal sums the longest last piece, and adds one to
the count of the prefix before it. Sums begin anew with each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.encode import MODEL
from folioscope.llm.pieces import Forward, Model, load
from folioscope.llm.words import pieces as runs

#: Words whose counts a task remembers between batches, and bytes of text that it takes at once.
REMEMBERED, PART = 150_000, 1 << 20


def automaton(model: Model):
    import ahocorasick

    a = ahocorasick.Automaton()
    for piece in model.ids:
        if model.unigram or piece in model.parts:
            a.add_word(piece, (len(piece), model.ids[piece]))
    a.make_automaton()
    return a


def count_word(word: str, matches, forward: Forward) -> int:
    """How many tokens a marked word has."""
    model = forward.model
    if not forward.simple(word):
        return sum(1 if p in model.ids else len(model.unknown(p)) for p in forward.plain(word))
    return _unigram_count(word, matches, forward) if model.unigram else _bpe_count(word, matches, forward)


def _unigram_count(word: str, matches, forward: Forward) -> int:
    model = forward.model
    state: list = [("", 0, np.float32(0))]
    counts = [0]
    ends: list[list[tuple[int, str]]] = [[] for _ in word]
    for end, (size, piece) in matches.iter(word):
        ends[end].append((end + 1 - size, forward.names[piece]))
    for end, found in enumerate(ends, 1):
        best = forward.best(iter(sorted(found)), state, end, word[end - 1])
        state.append(best)
        counts.append(counts[best[1]] + (1 if best[0] in model.ids else len(model.unknown(best[0]))))
    return counts[-1]


def _bpe_count(word: str, matches, forward: Forward) -> int:
    """A prefix's state is the id of its last piece, -1 for an unknown character and -2 for none yet, and the count."""
    apart, stay_apart = forward.apart, forward.stay_apart
    n = len(word)
    ids, counts = [-2] * (n + 1), [0] * (n + 1)
    ids[0], done = -1, 0
    for end, (size, piece) in matches.iter(word):
        end += 1
        while done < end - 1:  # ends that no piece fits
            done += 1
            if ids[done] == -2:
                ids[done], counts[done] = -1, counts[done - 1] + len(forward.model.unknown(word[done - 1]))
        if ids[end] == -2:
            start = end - size
            before = ids[start]
            if before < 0 or (apart[k] if (k := before << 32 | piece) in apart else stay_apart(before, piece)):
                ids[end], counts[end] = piece, counts[start] + 1
    while done < n:
        done += 1
        if ids[done] == -2:
            ids[done], counts[done] = -1, counts[done - 1] + len(forward.model.unknown(word[done - 1]))
    return counts[n]


def counter(model: Model):
    """For mapInArrow on (doc_id, text): (doc_id, n_chars, n_words, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward, matches, known = Forward(model), automaton(model), {}
        for batch in batches:
            for i, j, _, _ in runs(batch.column(1), PART):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                split = [model.marked_words(t) for t in texts]
                if len(known) > REMEMBERED:
                    known.clear()
                for word in {w for words in split for w in words} - known.keys():
                    known[word] = count_word(word, matches, forward)
                n = [sum(map(known.__getitem__, words)) for words in split]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t.split()) for t in texts], pa.int64()), pa.array(n, pa.int64())],
                    ["doc_id", "n_chars", "n_words", "n_tokens"],
                )

    return run


def token_counts(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, n_chars, n_words, n_tokens) of each row of ``docs``: doc_id, text.

    n_tokens is the number of ids that the model gives the whole text. Null and empty texts have
    none; null ids and repeated rows pass through; an empty table gives no rows, and other columns,
    whatever their names, are not read. A very long text is one row's work, in time linear in its
    length but for runs of spaces before a word, which take a heap.
    """
    return docs.select("doc_id", "text").mapInArrow(counter(load(model_path)), "doc_id long, n_chars long, n_words long, n_tokens long")
