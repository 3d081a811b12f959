"""SentencePiece encoding and decoding with a forward pass shared between words.

The distinct marked words of a batch are put in order, which is the depth-first order of their
trie. The stack of forward states is cut back to the prefix that a word shares with the one
before it and only the rest is computed.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.common import tidied
from folioscope.llm.pieces import SPACE, Forward, Model, load
from folioscope.llm.words import pieces as runs

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose ids a task remembers between batches.
REMEMBERED = 60_000
PART = 1 << 18
LONE_BYTE = re.compile("[\udc80-\udcff]")


def shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid
    return low


def encode_words(words: list[str], forward: Forward) -> dict[str, tuple[int, ...]]:
    """The ids of each of ``words``, which are distinct."""
    return _unigram_words(words, forward) if forward.model.unigram else _bpe_words(words, forward)


def _unigram_words(words: list[str], forward: Forward) -> dict[str, tuple[int, ...]]:
    model, out = forward.model, {}
    state: list = [("", 0, np.float32(0))]
    last = ""
    for word in sorted(words):
        del state[shared_prefix(last, word) + 1 :]
        for end in range(len(state), len(word) + 1):
            candidates = ((s, p) for s in range(max(0, end - model.longest), end) if (p := word[s:end]) in model.ids)
            state.append(forward.best(candidates, state, end, word[end - 1]))
        last, found, at = word, [], len(word)
        while at:
            found.append(state[at][0])
            at = state[at][1]
        out[word] = tuple(i for p in reversed(found) for i in ([model.ids[p]] if p in model.ids else model.unknown(p)))
    return out


def _bpe_words(words: list[str], forward: Forward) -> dict[str, tuple[int, ...]]:
    """A prefix's state is the id of its last piece, -1 for an unknown character, and where that begins."""
    model, apart, stay_apart, endings, out = forward.model, forward.apart, forward.stay_apart, forward.endings, {}
    ids, starts = [-1], [0]
    last = ""
    for word in sorted(words):
        if not forward.simple(word):
            out[word] = tuple(i for p in forward.plain(word) for i in ([model.ids[p]] if p in model.ids else model.unknown(p)))
            continue
        shared = shared_prefix(last, word) + 1
        del ids[shared:], starts[shared:]
        for end in range(shared, len(word) + 1):
            start = end - 1
            while start >= 0 and (piece := endings.get(word[start:end])) is not None:
                if piece >= 0 and ((before := ids[start]) < 0 or (apart[k] if (k := before << 32 | piece) in apart else stay_apart(before, piece))):
                    ids.append(piece)
                    starts.append(start)
                    break
                start -= 1
            else:
                ids.append(-1)
                starts.append(end - 1)
        last, found, at = word, [], len(word)
        while at:
            if (i := ids[at]) >= 0:
                found.append(i)
            else:
                found += model.unknown(word[at - 1])[::-1]
            at = starts[at]
        out[word] = tuple(found[::-1])
    return out


def spellings(model: Model) -> list[str]:
    """What each id stands for: a piece's text, and for the byte b the character b or, from 128 on, U+DC00 + b."""
    out = [" ⁇ " if i == model.unknown_id else "" for i in range(1 + max([model.unknown_id, *model.ids.values(), *model.byte_ids]))]
    for piece, i in model.ids.items():
        out[i] = piece
    for b, i in enumerate(model.byte_ids):
        out[i] = chr(b if b < 128 else 0xDC00 + b)
    return out


def decode(ids: list[int], spelled: list[str], prefix: bool) -> str:
    """The text of ``ids``: byte pieces together are UTF-8, marks are spaces, and the first mark that encoding added goes."""
    text = "".join(map(spelled.__getitem__, ids))
    if not text.isascii() and LONE_BYTE.search(text):
        text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    text = text.replace(SPACE, " ")
    return text[1:] if prefix and text.startswith(" ") else text


def encoder(model: Model):
    """For mapInArrow on (doc_id, text): (doc_id, ids, n_ids, round_trip)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward = Forward(model)
        known: dict[str, tuple[int, ...]] = {}
        spelled = spellings(model)
        for batch in batches:
            for i, j, _, _ in runs(batch.column(1), PART):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                split = [model.marked_words(t) for t in texts]
                if len(known) > REMEMBERED:
                    known.clear()
                known |= encode_words(list({w for words in split for w in words} - known.keys()), forward)
                flat, lengths, exact = array("i"), [], []
                for text, words in zip(texts, split):
                    ids = list(chain.from_iterable(map(known.__getitem__, words)))
                    flat.extend(ids)
                    lengths.append(len(ids))
                    exact.append(decode(ids, spelled, model.prefix) == text)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, np.int32))), pa.array(lengths, pa.int64()), pa.array(exact)],
                    ["doc_id", "ids", "n_ids", "round_trip"],
                )

    return run


def sentencepiece_encode(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip) of each row of ``docs``: doc_id, text, by the model's own rules.

    round_trip says that decoding the row's ids gives its text again, which is tried for each row and holds for
    every text without the mark U+2581 itself, if the model has byte pieces. Null and empty texts have no ids and a round trip; null ids and repeated
    rows pass through. A very long text is one row's work, in time linear in its length but for
    merges in runs of letters without spaces, which take a heap. An empty table gives no rows, and other columns,
    whatever their names, are not read. The model's tables, a few MB whatever the data, are read
    on the driver and travel with the tasks.
    """
    return docs.select("doc_id", "text").mapInArrow(tidied(encoder(load(model_path))), "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def sentencepiece_decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text, empty ones an empty text. Control pieces stand for nothing."""
    model = load(model_path)
    spelled = spellings(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode(x, spelled, model.prefix) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
